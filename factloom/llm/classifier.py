"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

For each of the two classes the mean and a covariance are taken, the covariance shrunk towards its own diagonal and towards the
pooled one; its Cholesky factor is cached with the model. A text's raw score is the difference of the two classes' log densities
(half the difference of squared Mahalanobis distances and of log determinants), and a one-dimensional logistic fit over the
training rows turns it into a score from 0 to 1.

Only the text enters a score. The model is fitted on a bounded sample of labelled rows, MOST_ROWS of each class at most, taken in
order of a hash of doc_id; every row is scored.

Defined results: null and empty texts have the statistics of a text without words and get a score like any other; labels that are
null are left out; a label for a document that is not there is ignored; a document that is labelled both ways is learnt from in both
classes; texts are read whole at any length; repeated rows are scored alike, and learnt from once; if either class has fewer
than MOST_FEW rows to learn from, every score is 0.5; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, batches_of, short_batches, texts

#: Labelled rows of each class that the model is fitted on, at most.
MOST_ROWS = 8_000
#: Rows of a class that a fit takes at least.
MOST_FEW = 5
FEATURES = ("words", "word_length", "upper", "symbols", "pipes", "bangs", "digits", "marks", "distinct", "neighbours", "repeated_lines", "unmarked_lines", "short_lines", "top_word")


@lru_cache(maxsize=1)
def _find():
    return re.compile(WORD).findall


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: logs of counts, and shares moved by a logit so that they spread around their ends."""
    words = _find()(text)
    n = len(words)
    chars = sum(map(len, words))

    def share(count: float, of: float, smooth: float = 0.5) -> float:
        return math.log((count + smooth) / (max(of - count, 0) + 10))

    letters: dict[str, int] = {}
    for w in words:
        letters[w] = letters.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    unmarked = sum(x.rstrip()[-1] not in ".!?:;…\"'»)]" for x in lines)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(n),
        chars / n if n else 0.0,
        share(upper, n),
        share(sum(map(text.count, "#*$%&<>")), chars),
        share(text.count("|"), n),
        share(text.count("!!"), n),
        share(sum(map(text.count, "0123456789")), chars),
        share(text.count(".") + text.count(",") + text.count("?") + text.count(";"), chars),
        share(n - len(letters), n),
        share(again, n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(unmarked, len(lines)),
        share(sum(len(x) < 20 for x in lines), len(lines)),
        share(max(letters.values(), default=0), n),
    ]


@dataclass
class Discriminant:
    """Per class: mean, lower Cholesky factor of the covariance and its log determinant; then the logistic's slope and offset."""

    means: list
    factors: list
    log_dets: list
    scale: object
    slope: float = 0.0
    offset: float = 0.0

    def raw(self, x):
        """Log density of class 1 less that of class 0 for rows of statistics."""
        import numpy as np

        z = x / self.scale
        parts = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            y = (z - mean).T.copy()
            for i in range(len(y)):  # forward substitution, a row of the factor at a time; no threaded library call in a worker
                for j in range(i):
                    y[i] -= factor[i, j] * y[j]
                y[i] /= factor[i, i]
            parts.append(-0.5 * (np.square(y).sum(axis=0) + log_det))
        return parts[1] - parts[0]

    def score(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.slope * np.cbrt(self.raw(x)) + self.offset, -500, 500)))


def fit(x, y, own: float = 0.85, diagonal: float = 0.1) -> Discriminant | None:
    """Fit on rows x with classes y (0 or 1); None if a class has too few rows. own: weight of a class covariance against the pooled
    one; diagonal: weight of its diagonal."""
    import numpy as np

    if min((y == 0).sum(), (y == 1).sum()) < MOST_FEW:
        return None
    scale = x.std(axis=0) + 1e-3
    z = x / scale
    groups = [z[y == c] for c in (0, 1)]
    means = [g.mean(axis=0) for g in groups]
    covs = [np.einsum("ni,nj->ij", g - m, g - m) / (len(g) - 1) for g, m in zip(groups, means)]
    pooled = sum(len(g) * c for g, c in zip(groups, covs)) / len(z)
    factors, log_dets = [], []
    for g, c in zip(groups, covs):
        trust = own * len(g) / (len(g) + x.shape[1])
        c = trust * c + (1 - trust) * pooled
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-2 * np.eye(len(c))
        factors.append(np.linalg.cholesky(c))
        log_dets.append(2 * np.log(np.diag(factors[-1])).sum())
    model = Discriminant(means, factors, log_dets, scale)
    # The raw difference grows with the square of the distance; its cube root keeps the logistic from being ruled by far rows.
    r, w = np.cbrt(model.raw(x)), np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
        g = np.array([(w * (p - y) * r).sum() + 0.1 * a, (w * (p - y)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * r * r).sum() + 0.1, (v * r).sum()], [(v * r).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(max(a, 0.05)), float(b)
    return model


def train(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Discriminant | None:
    """Fit on labelled rows (doc_id, quality) whose doc_id is in documents (doc_id, text): at most `most_rows` of each class, least
    hash first. That bound is what the driver collects and what the join broadcasts."""
    import numpy as np
    import pyarrow as pa

    short_batches(documents.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    picked = known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    picked = picked.unionByName(known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    out = pa.schema([("y", pa.int64()), ("id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            yield from batches_of(((y, k, statistics(t)) for y, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "text"))), out)

    # Repeated rows of a document are one, the least, so that the bound holds for what the driver gets.
    rows = own.select(F.col("y").cast("long"), "doc_id", "text").mapInArrow(run, "y long, id long, x array<double>").groupBy("y", "id").agg(F.min("x").alias("x")).toArrow()
    if not rows.num_rows:
        return None
    x, y, ids = np.array(rows["x"].to_pylist()), np.array(rows["y"].to_pylist()), np.array(rows["id"].to_pylist())
    order = np.lexsort((x[:, 0], y, ids))  # the fit doesn't depend on the order in which tasks end
    return fit(x[order], y[order])


def scores(documents: DataFrame, model: Discriminant | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns and `score` for every document; text must be among the table's columns. Narrow."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    short_batches(documents.sparkSession)
    schema = StructType([*(documents.schema[c] for c in columns), StructField("score", DoubleType())])
    out = to_arrow_schema(schema)

    def run(batches):
        import numpy as np

        for batch in batches:
            own = texts(batch, "text")
            if not own:
                continue
            s = np.full(len(own), 0.5) if model is None else model.score(np.array([statistics(t) for t in own]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(out.field(c).type) for c in columns), pa.array(s, pa.float64())], schema=out)

    return documents.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def accepted(documents: DataFrame, model: Discriminant | None, least: float) -> DataFrame:
    """The documents with a score of `least` or more, all columns as they are; without a model, all of them. Narrow."""
    import pyarrow as pa

    short_batches(documents.sparkSession)

    def run(batches):
        import numpy as np

        for batch in batches:
            own = texts(batch, "text")
            if model is not None and own:
                batch = batch.filter(pa.array(model.score(np.array([statistics(t) for t in own])) >= least))
            yield batch

    return documents.mapInArrow(run, documents.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that are kept from learning: crc32 of doc_id as text leaves 2 when divided by four."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
