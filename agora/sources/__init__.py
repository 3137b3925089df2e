from agora.sources import fixtures, io

__all__ = ["fixtures", "io"]
