"""Saving and loading of the library's own models with Spark ML's writers, so they fit in a PipelineModel."""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class _Writer(MLWriter):
    def __init__(self, model: SavedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"fitted": self.model._fitted()})
        self.model._save_parts(path)


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SavedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls._restore(metadata["fitted"], path, self.sparkSession)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class SavedModel(MLWritable, MLReadable):
    """A model with small fitted values (saved as JSON) and maybe parts with a folder of their own."""

    def _fitted(self) -> dict:
        return {}

    def _save_parts(self, path: str) -> None:
        pass

    @classmethod
    def _restore(cls, fitted: dict, path: str, spark):
        return cls(**fitted)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)
