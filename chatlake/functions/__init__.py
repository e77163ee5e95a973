"""Column functions: text helpers, masking, vocabulary."""
