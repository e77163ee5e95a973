"""DataFrame operators: chunking, topics, embedding, index, retrieval, answering, workflows, triage, queue."""
