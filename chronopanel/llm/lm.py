"""Document scores by the cross-entropy difference of two language models (Moore and Lewis, 2010)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import numbered, slices

#: Characters of a gram: a token with the three before it.
ORDER = 4
#: Weight of the next shorter model in every distribution, as a number of observations.
PRIOR = 5.0
BLOCK_BYTES = 8 << 20
#: Stands before a document's first character; it is no character.
BEFORE = "\U0010ffff"


class Grams:
    """Distinct grams of some texts, and the number of the gram that ends at each character."""

    def __init__(self, texts: list[str]):
        pad = BEFORE * (ORDER - 1)
        points = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        letters, ids = numbered(points, 0x110000)
        real = np.ones(len(points), bool)
        starts = np.cumsum(self.sizes + ORDER - 1) - self.sizes
        for k in range(1, ORDER):
            real[starts - k] = False
        del points
        # two characters first, then two of those: numbers stay small for any alphabet
        size = max(1, len(letters))
        pairs, two = numbered(ids[:-1].astype(np.int64) * size + ids[1:], size * size)
        del ids
        many = max(1, len(pairs))
        four = two[:-2].astype(np.int64) * many + two[2:]
        codes, self.of = numbered(four[real[ORDER - 1 :]], many * many)
        parts = np.stack([pairs[codes // many], pairs[codes % many]], axis=1) if len(codes) else np.empty((0, 2), np.int64)
        text = letters[np.stack([parts // size, parts % size], axis=2).reshape(-1)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self.grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds, written: a document with its block, and a gram of a block with its counts in both corpora."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            keys_type = batch.schema.field(0).type
            target = batch.column(2).to_pylist()
            done = 0
            for keys, texts in slices([batch], BLOCK_BYTES):
                found = Grams(texts)
                mine = np.array(target[done : done + len(keys)], np.float64)
                done += len(keys)
                n, m = len(keys), len(found.grams)
                back = np.bincount(found.of, minlength=m).astype(np.int64)
                aim = np.bincount(found.of, weights=np.repeat(mine, found.sizes), minlength=m).astype(np.int64)
                none = lambda k, t: pa.nulls(k, t)
                names = ["block", "doc_id", "text", "gram", "target", "background"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(keys, keys_type), pa.array(texts, pa.string()), none(n, pa.string()), none(n, pa.int64()), none(n, pa.int64())],
                    names=names,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, block)), none(m, keys_type), none(m, pa.string()), pa.array(found.grams, pa.string()), pa.array(aim), pa.array(back)],
                    names=names,
                )
                block += 1

    return stored(docs.mapInArrow(run, f"block long, doc_id {id_type}, text string, gram string, target long, background long"), "blocks")


def model(grams: DataFrame) -> DataFrame:
    """(gram, log_target, log_background) from counted grams: p(d | abc) = (c(abcd) + PRIOR p(d | bc)) / (c(abc) + PRIOR),
    down to one over the number of different characters.  Both models have the same grams and characters."""
    c, sides = F.col, ("target", "background")
    letters = grams.select(F.substring("gram", ORDER, 1).alias("x")).distinct().count()
    lower = None
    for n in range(1, ORDER + 1):
        counts = grams.groupBy(F.substring("gram", ORDER - n + 1, n).alias("gram")).agg(*[F.sum(s).alias(s) for s in sides])
        counts = counts.withColumn("context", F.substring("gram", 1, n - 1)).withColumn("shorter", F.substring("gram", 2, n - 1))
        around = counts.groupBy("context").agg(*[F.sum(s).alias(f"of_{s}") for s in sides])
        table = counts.join(around, "context")
        if lower is None:
            table = table.select("*", *[F.lit(1.0 / max(1, letters)).alias(f"low_{s}") for s in sides])
        else:
            table = table.join(lower, "shorter")
        share = lambda s: (c(s) + PRIOR * c(f"low_{s}")) / (c(f"of_{s}") + PRIOR)
        level = stored(table.select("gram", *[share(s).alias(s) for s in sides]), "model")
        lower = level.select(c("gram").alias("shorter"), *[c(s).alias(f"low_{s}") for s in sides])
    return level.select("gram", *[F.log(s).alias(f"log_{s}") for s in sides])


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "target") -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) per row; tokens are characters, losses nats per token, and the
    score is the target's loss less the background's: the lower, the more like the target.

    Target documents are those whose ``target_col`` is true, the background is all documents.  All texts are counted: each
    task counts blocks of its documents, counts meet by gram, and a block is sent the values of its own grams only, so no
    table of all grams is ever held in one place.  Null texts are empty; empty texts have no losses; without target documents
    the target model is uniform; repeated rows count and score each; an empty table gives no rows; other columns are ignored.
    """
    c = F.col
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(docs[target_col].cast("boolean"), F.lit(False)).alias("target"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(rows)
    local = blocks.filter("gram IS NOT NULL").select("block", "gram", "target", "background")
    grams = stored(local.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background")), "grams")
    valued = local.select(c("block").alias("of"), "gram").join(model(grams), "gram")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").to_pylist()
        found = Grams(texts)
        place = {g: i for i, g in enumerate(right.column("gram").to_pylist())}
        order = np.array([place[g] for g in found.grams], np.int64)
        sums = []
        owner = np.repeat(np.arange(len(texts)), found.sizes)
        for name in ("log_target", "log_background"):
            value = right.column(name).to_numpy()[order] if len(order) else np.empty(0)
            sums.append(np.bincount(owner, weights=-value[found.of], minlength=len(texts)))
        n = found.sizes
        mean = [pa.array(np.divide(s, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0) for s in sums]
        gap = pa.array(np.divide(sums[0] - sums[1], n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
        return pa.table([left.column("doc_id"), pa.array(n), *mean, gap], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    texts = blocks.filter("gram IS NULL").select("block", "doc_id", "text")
    return texts.groupBy("block").cogroup(valued.groupBy("of")).applyInArrow(
        score, f"doc_id {id_type}, n_tokens long, loss_target double, loss_background double, score double"
    )
