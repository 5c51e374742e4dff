"""An archive as a value: its relations and the plans that combine them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from vaultframe.operators import blobs, images, mutate, verify


@dataclass(frozen=True)
class Archive:
    """Relations of one archive; nothing in it changes, each operation gives a new one or raises."""

    entries: DataFrame
    blobs: DataFrame
    properties: DataFrame | None = None

    @classmethod
    def of(cls, entries: DataFrame, properties: DataFrame | None = None) -> Archive:
        return cls(entries, blobs.blob_table(entries), properties)

    def export(self, source: Archive, names: list[str] | None = None) -> Archive:
        return Archive.of(images.exported(self.entries, source.entries, names), self.properties)

    def select(self, names: list[str]) -> Archive:
        return Archive.of(images.selected(self.entries, names).drop("image_id"), self.properties)

    def update(self, commands: list[tuple]) -> Archive:
        return Archive.of(mutate.updated(self.entries, commands), self.properties)

    def with_property(self, image: str, path: str, value: str) -> Archive:
        return replace(self, properties=mutate.with_property(self.properties, image, path, value))

    def stats(self) -> DataFrame:
        return images.image_stats(self.entries)

    def verify(self, content: DataFrame, strict: bool = False) -> DataFrame:
        """Faults found: entries without content, contents with another digest."""
        from pyspark.sql import functions as F

        lost = verify.missing_content(self.entries, self.blobs, strict).select(F.lit("missing").alias("fault"), "hash")
        return lost.unionByName(verify.corrupt_content(content, strict).select(F.lit("corrupt").alias("fault"), "hash"))
