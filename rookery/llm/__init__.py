"""Training-data operators: each module here is one operator over a documents or embeddings table."""
