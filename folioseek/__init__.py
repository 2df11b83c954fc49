"""Document retrieval and question answering as Spark DataFrame jobs."""

from folioseek.config import ChunkSettings, ModelSettings, model_settings

__all__ = ["ChunkSettings", "ModelSettings", "model_settings"]
