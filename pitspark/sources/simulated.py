"""A source of simulated bars, as a Python data source: ``spark.read.format("simulated_bars")``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Part(InputPartition):
    def __init__(self, asset: int, bars: int):
        self.asset, self.bars = asset, bars


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.assets, self.bars = int(options.get("assets", 2)), int(options.get("bars", 3))

    def partitions(self) -> list[InputPartition]:
        return [_Part(k, self.bars) for k in range(self.assets)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n in range(partition.bars):
            base = 100.0 + 10 * partition.asset + ((n * 7919 + partition.asset * 104729) % 97) / 10
            yield f"asset-{partition.asset}", n, base, base + 1.5, base - 1.25, base + 0.5, 1000.0 + n


class SimulatedBars(DataSource):
    """Deterministic bars, one partition an asset; options assets and bars."""

    @classmethod
    def name(cls) -> str:
        return "simulated_bars"

    def schema(self) -> str:
        return "asset_id string, period long, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
