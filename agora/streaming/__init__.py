from agora.streaming.append import append_embeddings

__all__ = ["append_embeddings"]
