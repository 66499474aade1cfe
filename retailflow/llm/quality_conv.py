"""Operator 1: a byte-level convolutional network for document quality, in numpy.

What a place shows is its byte, and whether the GRAM bytes from there on stood within the
LOOK bytes before as well: 512 symbols. Learned filters of WIDTH places slide along a
document from its first byte on; their rectified responses are summed over steps of STEP
places. A second layer of learned filters looks at chunks of CHUNK steps, one beginning at
every step, so that chunks overlap and cover the whole document. Each of these filters keeps
its largest response over all chunks, and the largest ones are combined into one
probability: so one bad chunk is enough to be seen, wherever in the document it is.

A score depends on the bytes of the document alone: places are counted from its own start,
and what stands beyond its end is zero. The network is trained here, by Adam on a bounded
sample of labelled rows, in one task.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, prepare, text_buffers

#: Shape of the network: bytes that a filter sees and between its places, places of a step,
#: steps of a chunk, filters of either layer.
WIDTH, STRIDE, STEP, CHUNK = 6, 3, 6, 8
FILTERS, UNITS = 12, 24
#: Bytes that are looked for among those before, and how far back.
GRAM, LOOK = 4, 48
STEP_BYTES = STRIDE * STEP
#: Labelled rows that the network is trained on at most (about 10 MB of text).
TRAIN_ROWS = 3000
EPOCHS, LEAST_STEPS, RATE, SEED = 12, 400, 0.02, 11
THRESHOLD = 0.3
#: Decimals of a score; below them the order of sums would show.
DECIMALS = 9


class Cut:
    """Some texts, or stretches of texts, laid out for the network.

    Each has `steps` steps from byte `begin` of data on, and the LOOK bytes before as far as
    its text (from `start` on) has them; places beyond its text hold zeros.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, steps: np.ndarray | None = None):
        size = end - begin
        whole = np.maximum(1, -(-size // STEP_BYTES))
        self.steps = np.maximum(CHUNK, whole if steps is None else steps)
        # own places in a copy, as many as its steps reach
        room = self.steps * STEP_BYTES + WIDTH - STRIDE + GRAM - 1
        at = np.cumsum(room + LOOK) - room
        copy = np.zeros(int((room + LOOK).sum()), np.uint8)
        before = np.minimum(begin - start, LOOK)
        n = before + np.minimum(size, room)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n + before, n)
        copy[k + np.repeat(at, n)] = data[k + np.repeat(begin, n)]
        gram = copy[: len(copy) - GRAM + 1].astype(np.uint32)
        for k in range(1, GRAM):
            gram |= copy[k : len(copy) - GRAM + 1 + k].astype(np.uint32) << np.uint32(8 * k)
        again = np.zeros(len(gram), bool)
        for lag in range(2, LOOK + 1):
            again[lag:] |= gram[lag:] == gram[:-lag]
        self.symbol = copy[: len(gram)] + again * np.uint16(256)
        self.first = np.cumsum(self.steps) - self.steps
        total = int(self.steps.sum())
        step = np.arange(total) - np.repeat(self.first, self.steps)
        base = np.repeat(at, self.steps) + step * STEP_BYTES
        self.place = (base[:, None] + np.arange(STEP) * STRIDE).ravel()
        # the steps at which chunks begin, and each text's first one of these
        own = self.steps - CHUNK + 1
        self.chunk_first = np.cumsum(own) - own
        self.chunk = np.repeat(self.first, own) + np.arange(int(own.sum())) - np.repeat(self.chunk_first, own)


class Network:
    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        self.p = {
            "table": g.normal(0, 0.15, (WIDTH, 512, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "chunks": g.normal(0, 0.08, (CHUNK, FILTERS, UNITS)).astype(np.float32),
            "shift": np.zeros(UNITS, np.float32),
            "out": g.normal(0, 0.3, UNITS).astype(np.float32),
            "last": np.zeros(1, np.float32),
        }

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **self.p)
        return f.getvalue()

    @staticmethod
    def load(raw: bytes) -> "Network":
        net = Network.__new__(Network)
        with np.load(io.BytesIO(raw)) as z:
            net.p = {k: z[k] for k in z.files}
        return net

    def responses(self, cut: Cut) -> np.ndarray:
        """First filters at every place; the table has a weight for each place, symbol and
        filter, so a convolution over one-hot symbols is a sum of looked-up rows."""
        r = np.broadcast_to(self.p["bias"], (len(cut.place), FILTERS)).astype(np.float32)
        for k in range(WIDTH):
            r += self.p["table"][k][cut.symbol[cut.place + k]]
        return r

    def second(self, steps: np.ndarray, cut: Cut) -> np.ndarray:
        """Second filters on every chunk."""
        out = np.zeros((len(cut.chunk), UNITS)) + self.p["shift"]
        for k in range(CHUNK):
            out += (steps @ self.p["chunks"][k].astype(np.float64))[cut.chunk + k]
        return np.tanh(out)

    def largest(self, cut: Cut) -> np.ndarray:
        """Each text's largest response of each second filter."""
        first = np.maximum(self.responses(cut), 0)
        steps = first.reshape(-1, STEP, FILTERS).astype(np.float64).sum(1)
        return np.maximum.reduceat(self.second(steps, cut), cut.chunk_first)

    def scores(self, data: np.ndarray, offsets: np.ndarray, piece: int = PIECE_BYTES) -> np.ndarray:
        """The probability of label 1 for each text data[offsets[i] : offsets[i + 1]].

        Long texts go in stretches that share CHUNK - 1 steps: the largest over stretches is
        the largest over the whole.
        """
        most = max(1, piece // STEP_BYTES)
        size = np.diff(offsets)
        chunks = np.maximum(1, -(-size // STEP_BYTES) - CHUNK + 1)
        parts = -(-chunks // most)
        text = np.repeat(np.arange(len(size)), parts)
        k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        steps = np.minimum(most, chunks[text] - k * most) + CHUNK - 1
        start, end = offsets[:-1][text], offsets[1:][text]
        begin = start + k * most * STEP_BYTES
        pooled = np.full((len(size), UNITS), -np.inf)
        load = np.cumsum(steps)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + most, "right")))
            np.maximum.at(pooled, text[i:j], self.largest(Cut(data, start[i:j], begin[i:j], end[i:j], steps[i:j])))
            i = j
        z = (pooled * self.p["out"].astype(np.float64)).sum(1) + float(self.p["last"][0])
        return np.round(1 / (1 + np.exp(-z)), DECIMALS)

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 64, seed: int = SEED) -> None:
        """Adam on the log loss, both labels weighing the same; a small sample is gone over
        until there are LEAST_STEPS."""
        g = np.random.default_rng(seed)
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(texts) // batch)))
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = g.permutation(len(texts))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                at = np.cumsum([0, *(len(texts[j]) for j in own)])
                cut = Cut(np.frombuffer(b"".join(texts[j] for j in own), np.uint8), at[:-1], at[:-1], at[1:])
                raw = self.responses(cut)
                on = raw > 0
                steps = (raw * on).reshape(-1, STEP, FILTERS).astype(np.float64).sum(1)
                h = self.second(steps, cut)
                pooled = np.maximum.reduceat(h, cut.chunk_first)
                y = 1 / (1 + np.exp(-(pooled @ self.p["out"] + self.p["last"][0])))
                d = (y - labels[own]) * weight[own] / len(own)
                grad = {"out": pooled.T @ d + 1e-4 * self.p["out"], "last": np.array([d.sum()])}
                number = np.diff(np.append(cut.chunk_first, len(cut.chunk)))
                text = np.repeat(np.arange(len(own)), number)
                # the gradient goes to one largest chunk of each text and filter
                key = np.where(h == pooled[text], np.arange(len(h))[:, None], len(h))
                best = np.minimum.reduceat(key, cut.chunk_first).ravel()
                unit = np.tile(np.arange(UNITS), len(own))
                dz = (d[:, None] * self.p["out"] * (1 - pooled * pooled)).ravel()
                grad["shift"] = np.bincount(unit, dz, UNITS)
                dh = np.zeros((len(h), UNITS))
                dh[best, unit] = dz
                rows = np.unique(best)
                dh = dh[rows]
                grad["chunks"] = np.empty((CHUNK, FILTERS, UNITS))
                ds = np.zeros_like(steps)
                for k in range(CHUNK):
                    where = cut.chunk[rows] + k
                    grad["chunks"][k] = steps[where].T @ dh + 1e-4 * self.p["chunks"][k]
                    ds[where] += dh @ self.p["chunks"][k].T
                hot = np.flatnonzero(ds.any(1))
                place = (hot[:, None] * STEP + np.arange(STEP)).ravel()
                dr = np.repeat(ds[hot], STEP, axis=0) * on[place]
                grad["bias"] = dr.sum(0)
                grad["table"] = np.empty_like(self.p["table"])
                for k in range(WIDTH):
                    b = cut.symbol[cut.place[place] + k]
                    for f in range(FILTERS):
                        grad["table"][k, :, f] = np.bincount(b, dr[:, f], 512)
                step += 1
                for k in self.p:
                    m[k] += 0.1 * (grad[k] - m[k])
                    v[k] += 0.001 * (grad[k] ** 2 - v[k])
                    self.p[k] -= (rate / (1 + 3 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _train_task(batches):
    """In: (text, label) rows, at most TRAIN_ROWS. Out: one network."""
    import pyarrow as pa

    texts, labels = [], []
    for batch in batches:
        texts += [(t or "").encode() for t in batch.column("text").to_pylist()]
        labels += batch.column("label").to_pylist()
    net = Network()
    if texts and len(set(labels)) == 2:
        net.train(texts, np.asarray(labels, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([net.dump()], pa.binary())], names=["net"])


def fit(docs: DataFrame, labels: DataFrame, held_out, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """A network trained on at most `rows` labelled rows outside held_out, half of them of
    either label where there are so many.

    The rows are those with the least hash of their id, so the sample is the same for the
    same table. Null labels, and rows with neither 0 nor 1, aren't used; of several labels
    of an id the least is, and of several texts the one with the least hash. Without rows
    of both labels the network is untrained and scores say nothing.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND _id IS NOT NULL").groupBy("_id").agg(F.min("label").alias("label"))
    known = known.where(~held_out(F.col("_id"))).withColumn("_o", F.xxhash64("_id", F.lit(SEED)))
    picked = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy("_o", "_id").limit(rows // 2)
        picked = some if picked is None else picked.unionByName(some)
    # at most `rows` ids, so both sides of what follows are bounded
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id")
    texts = texts.groupBy("_o", "_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    out = texts.orderBy("_o", "_id").limit(rows).select("text", "label").coalesce(1).mapInArrow(_train_task, "net binary")
    made = out.first()  # none where there are no rows at all
    return Network.load(bytes(made[0])) if made else Network()


def score(
    docs: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, out: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """The kept columns, score (of label 1, from 0 to 1) and predicted of every row.

    A score depends on the whole text and nothing else: equal texts score the same wherever
    they stand. Empty and null texts have the score of a text of no bytes. Every row gives
    one row, null and repeated ids too; other columns are left out. Outputs can be named
    otherwise by `out`; a kept name that clashes raises ValueError. An empty table gives none.
    """
    import pyarrow as pa

    if clash := set(out) & set(keep):
        raise ValueError(f"kept columns clash with outputs: {sorted(clash)}")
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(net.dump())
    name = text if text in keep else "_text"
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(name))
    fields = [f for f in rows.schema.fields if f.name in keep]

    def run(batches):
        own = Network.load(shared.value)
        for batch in batches:
            if batch.num_rows:
                s = own.scores(*text_buffers(batch.column(name)))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(s)], names=[*(f.name for f in fields), out[0]])

    schema = rows.select(*keep).schema.add(out[0], "double")
    return rows.mapInArrow(run, schema).withColumn(out[1], (F.col(out[0]) >= threshold).cast("int"))
