"""Panel files: paired CSV files of sums and means, one column per region and band, as one scan.

A data source with one partition per file. Only names are listed while the plan is made; each task reads its file line by line
and parses the header itself, so any number of files is one scan and one shuffle.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Mapping
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import time

MEASURES = ["swe_total", "swe_mean_mm", "swe_total_roll", "swe_mean_roll_mm"]

# File names of the levels, and header rows and metres per pixel of each level.
NAMES = {"alps": r"SWE", "country": r"SWE_countries", "catchment": r"SWE_catchments", "heightband": r"(?P<region>.+)_heightbands"}
HEADER_ROWS = {"alps": 1, "country": 2, "catchment": 1, "heightband": 1}
PIXELS = {"alps": 300, "country": 300, "catchment": 100, "heightband": 100}


def _open(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def parse_date(text: str) -> date | None:
    """ISO or US date, with or without a time behind it; None when neither reads."""
    head = re.split(r"[ T]", text.strip(), maxsplit=1)[0]
    for form in ("%Y-%m-%d", "%m/%d/%Y"):
        try:
            return datetime.strptime(head, form).date()
        except ValueError:
            pass
    return None


def parse_number(text: str) -> float | None:
    """A finite number; None for anything else."""
    try:
        x = float(text)
    except ValueError:
        return None
    return x if x - x == 0 else None


def column_key(level: str, region: str | None, head: list[str]) -> tuple[str, str, bool]:
    """(region, band, rolled) of one column from its header cells."""
    name = head[-1]
    rolled, plain = name.endswith("_roll"), name.removesuffix("_roll").removesuffix("_raw")
    return {"alps": ("Alps", "total", rolled), "country": (head[0], plain, rolled), "catchment": (plain, "total", rolled),
            "heightband": (region or "", plain, rolled)}[level]


def parse_lines(lines: Iterator[str], level: str, region: str | None) -> Iterator[tuple]:
    """(region, band, rolled, day, line, value) of every cell under a readable date; short lines have no cells at their end."""
    reader = csv.reader(lines)
    header = [row for _, row in zip(range(HEADER_ROWS[level]), reader)]  # noqa: B905
    if len(header) < HEADER_ROWS[level]:
        return
    keys = [column_key(level, region, list(cells)) for cells in zip(*(row[1:] for row in header), strict=False)]
    for number, row in enumerate(reader):
        day = parse_date(row[0]) if row else None
        if day is not None:
            for key, cell in zip(keys, row[1:] + [""] * (len(keys) - len(row) + 1), strict=False):
                yield (*key, day, number, parse_number(cell))


class PanelFile(InputPartition):
    def __init__(self, name: str, mean: bool, level: str, region: str | None):
        self.name, self.mean, self.level, self.region = name, mean, level, region


class PanelReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[PanelFile]:
        from pyarrow import fs
        store, path = _open(self.folder)
        out = []
        for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            for level, name in NAMES.items():
                m = re.fullmatch(rf"(?P<kind>[tm])-{name}_timeseries\.csv", info.base_name)
                if m and info.is_file:
                    out.append(PanelFile(info.base_name, m["kind"] == "m", level, m.groupdict().get("region")))
                    break
        return out

    def read(self, partition: PanelFile) -> Iterator[tuple]:
        if not isinstance(partition, PanelFile):  # a folder without panel files
            return
        store, path = _open(self.folder)
        with store.open_input_stream(f"{path}/{partition.name}", compression=None) as raw:
            lines = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")
            for region, band, rolled, day, line, value in parse_lines(lines, partition.level, partition.region):
                yield partition.level, region, band, partition.mean, rolled, day, line, value


class PanelSource(DataSource):
    """``spark.read.format("panel_csv").load(folder)``: one row per cell of all panel files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "panel_csv"

    def schema(self) -> str:
        return "level string, region string, band string, mean boolean, rolled boolean, day date, line long, value double"

    def reader(self, schema) -> PanelReader:
        return PanelReader(self.options["path"])


def read_panels(spark: SparkSession, folder: str, pixels: Mapping[str, int] = PIXELS) -> DataFrame:
    """All panel files of a folder as one row per (day, level, region, band) with the four measures.

    The later of two lines for one day counts, its empty cells included. A day that only one file of a pair has is kept with the
    other side NULL; days without any number go. The folder must be one that all machines see; a folder without files gives no rows.
    """
    spark.dataSource.register(PanelSource)
    cells = spark.read.format("panel_csv").load(folder)
    last = {m: F.max(F.when((F.col("mean") == ("mean" in m)) & (F.col("rolled") == ("roll" in m)), F.struct("line", "value")))["value"].alias(m) for m in MEASURES}
    g = cells.groupBy("day", "level", "region", "band").agg(*last.values()).filter(F.coalesce(*MEASURES).isNotNull())
    size = F.create_map(*[F.lit(x) for pair in pixels.items() for x in pair])
    return g.select("day", "level", "region", "band", *MEASURES, F.try_element_at(size, F.col("level")).alias("pixel_size_m"),
                    time.winter_season(F.col("day")).alias("winter_season"), time.day_of_winter(F.col("day")).alias("day_of_winter"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Write rows (file, place, text) as text files of those names, each streamed by one task in the order of place."""
    def put(batches):
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        name = out = None
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    if out is not None:
                        out.close()
                    name, out = file, store.open_output_stream(f"{path}/{file}", compression=None)
                out.write(f"{text}\n".encode())
        if out is not None:
            out.close()
        yield from ()

    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "text").mapInArrow(put, "file string").count()


__all__ = ["MEASURES", "PIXELS", "PanelSource", "read_panels", "write_lines"]
