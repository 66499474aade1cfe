"""The charset of an export, by all of its bytes.

Tasks read the lines of files as bytes. A file whose lines are all valid is UTF-8; one of
which half of the bytes are the upper halves of letters is UTF-16; for the others each
Cyrillic charset is rated by its letters' frequency, by pairs of bytes whose letters' cases
and kinds don't follow each other in words, and by bytes that it has no letter for. The
ratings are sums over bytes and pairs, so that a task gives one row for each of its files.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.session import ship_package

#: Charsets by Java's names, with Python's; of equally rated ones the first is taken.
CHARSETS = {"windows-1251": "cp1251", "KOI8-R": "koi8_r", "IBM866": "cp866", "ISO-8859-5": "iso8859_5", "x-MacCyrillic": "mac_cyrillic", "IBM855": "cp855"}
PYTHON_NAMES = {**CHARSETS, "UTF-8": "utf-8", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}

# Occurrences of Russian letters in 100,000.
FREQUENCY = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10983, 8483, 7998, 7367, 6700, 6318, 5473, 4746, 4533, 4343, 3486, 3203, 2977, 2804, 2615, 2001, 1898, 1735, 1687, 1641, 1592, 1450, 1208, 966, 940, 718, 639, 486, 361, 331, 267, 37, 13), strict=True))
VOWELS = frozenset("аеёиоуыэюя")

#: Ratings of a byte that is another sign than a letter, and of one that stands for nothing.
SIGN, NOTHING = np.log(1e-5), np.log(1e-9)
#: Ratings of a small letter with a capital behind it, and of two vowels or two consonants.
CASE, ALIKE = -6.0, -0.7


def _letters(codec: str) -> list[str | None]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(None)
    return out


def ratings() -> tuple[np.ndarray, np.ndarray]:
    """charsets x 256 and charsets x 65536: what a byte and a pair of bytes add to a rating."""
    single, double = np.zeros((len(CHARSETS), 256)), np.zeros((len(CHARSETS), 256, 256))
    for k, codec in enumerate(CHARSETS.values()):
        letters = _letters(codec)
        russian = np.array([c is not None and c.lower() in FREQUENCY for c in letters])
        for b in range(128, 256):
            c = letters[b]
            single[k, b] = np.log(FREQUENCY[c.lower()] / 1e5) if russian[b] else NOTHING if c is None else SIGN
        capital = np.array([bool(r) and c.isupper() for c, r in zip(letters, russian, strict=True)])
        vowel = np.array([bool(r) and c.lower() in VOWELS for c, r in zip(letters, russian, strict=True)])
        both = russian[:, None] & russian[None]
        double[k] = np.where(both & ~capital[:, None] & capital[None], CASE, 0.0) + np.where(both & (vowel[:, None] == vowel[None]), ALIKE, 0.0)
        double[k, :128] = double[k, :, :128] = 0
    return single, double.reshape(len(CHARSETS), -1)


def _facts(batches):
    """For each file of a task: bytes, zeros and fours, those at even and at odd places of its
    first line, lines that aren't UTF-8, and the rating of each charset."""
    import pyarrow as pa

    single, double = ratings()
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        values, files = batch.column("value"), batch.column("file").to_pylist()
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
        wrong = ~np.asarray(batch.column("valid").to_numpy(zero_copy_only=False), bool)
        edges = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
        for i, j in zip(edges, edges[1:], strict=False):
            x = data[at[i] : at[j]]
            begins = files[i] not in found and batch.column("block")[i].as_py() == 0
            upper = np.isin(data[at[i] : at[i + 1]] if begins else x[:0], (0, 4))
            facts = np.array([len(x), (x == 0).sum(), (x == 4).sum(), upper[::2].sum(), upper[1::2].sum(), wrong[i:j].sum()], np.int64)
            rated = single @ np.bincount(x, minlength=256)
            if wrong[i:j].any():
                rated = rated + double @ np.bincount(x[:-1].astype(np.int64) << 8 | x[1:], minlength=1 << 16)
            old = found.get(files[i], (0, 0))
            found[files[i]] = old[0] + facts, old[1] + rated
    names = ["file", "facts", "rated"]
    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([f.tolist() for f, _ in found.values()], pa.list_(pa.int64())), pa.array([r.tolist() for _, r in found.values()], pa.list_(pa.float64()))], names=names)


def _charset(facts: list[int], rated: list[float]) -> str:
    size, zeros, fours, even, odd, wrong = facts
    if zeros and zeros + fours > 0.35 * size:  # only a file's first line shows which byte is the upper one
        return "UTF-16LE" if odd > even else "UTF-16BE"
    return "UTF-8" if not wrong else list(CHARSETS)[int(np.argmax(rated))]


def lines_of(spark: SparkSession, path, charset: str | None = None) -> DataFrame:
    """file, block and value of each line as bytes, in the order of the files within a task."""
    reader = spark.read.option("lineSep", "\n")
    if charset and charset.startswith("UTF-16"):
        reader = reader.option("encoding", charset)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def detect(spark: SparkSession, path) -> dict[str, str]:
    """The charset of each file of a path, by Java's name. A file without any line isn't listed.

    All bytes are looked at, in as many tasks as Spark reads the files in; one row for each
    file and task is added up, and one for each file comes to the driver. Pure ASCII is UTF-8.
    """
    ship_package(spark)
    lines = lines_of(spark, path).select("file", "block", F.col("value").cast("binary").alias("value"), F.is_valid_utf8("value").alias("valid"))
    facts = lines.mapInArrow(_facts, "file string, facts array<long>, rated array<double>")
    each = [F.sum(F.col("facts")[i]).alias(f"f{i}") for i in range(6)] + [F.sum(F.col("rated")[i]).alias(f"r{i}") for i in range(len(CHARSETS))]
    rows = facts.groupBy("file").agg(*each).collect()
    return {r.file: _charset([r[f"f{i}"] for i in range(6)], [r[f"r{i}"] for i in range(len(CHARSETS))]) for r in rows}
