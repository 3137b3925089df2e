from agora.functions import constants, maps, text, vectors

__all__ = ["constants", "maps", "text", "vectors"]
