"""The engine facade, the command line and the registry of queries."""
