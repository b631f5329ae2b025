"""Quality rules by robust multivariate outliers.

Each whole text becomes a transformed statistic vector. Within each (lang,
source) group a minimum-covariance-determinant estimate (MCD) describes the
central `ALPHA` share of the vectors; texts whose Mahalanobis distance from it
passes the cut are rejected.

The MCD runs as aggregates, never holding a group in memory: a concentration
step groups vectors by (group, start, logarithmic distance bucket) and sums
their first and second moments; the h-subset is the buckets up to the one that
reaches the share, so equal distances stay together and a repeat run takes the
same subset. Two deterministic starts (coordinatewise median and quartiles;
mean and full covariance) are carried side by side, and the smaller
determinant wins; a reweighting step follows. Groups with fewer than
`min_group` vectors use their language's estimate, small languages that of the
whole table, and a table smaller than that rejects only texts without a vector.

Defined cases: null, empty and letterless texts have no vector and are
rejected; null lang or source is a group of its own; a null doc_id is judged
like any other; repeated rows count as often as they come and are all judged
alike; coordinates that don't vary have the variance floor; an empty table gives
no rows; extra columns are ignored or carried untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import subset, written

STATS = ["length", "word_length", "letters", "upper", "symbols", "variety", "repetition", "line_words"]
P = len(STATS)
X = [f"x{i}" for i in range(P)]
ALPHA = 0.75
#: Standard deviations of harmless differences in these units; their squares are added to each variance, so that
#: a coordinate that hardly varies in a group (no digit, no repeated line) doesn't make one phone number an outlier.
FLOOR = np.array([0.6, 0.10, 0.35, 0.6, 0.9, 0.05, 0.6, 0.5])
_VECTOR = T.StructType([T.StructField(x, T.DoubleType()) for x in X])
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

_KIND = np.zeros(0x3001, np.uint8)  # 1 lower-case or caseless letter, 2 upper, 3 digit, 4 space, 5 symbol
for _c in range(0x3000):
    _s = chr(_c)
    _KIND[_c] = 2 if _s.isupper() else 1 if _s.isalpha() else 3 if _s.isdigit() else 4 if _s.isspace() else 5
_KIND[0x3000] = 1
_PLAIN = np.isin(np.arange(0x3001), [ord(c) for c in ".,;:'\"-()?"])


def _logit(n: np.ndarray, total: np.ndarray, a: float, b: float) -> np.ndarray:
    """Of a share that is shrunk towards a/(a+b), so that short texts don't reach its ends."""
    return np.log((n + a) / (total - n + b))


def vectors(texts: list[str | None]) -> np.ndarray:
    """[n, P] statistic vectors, NaN rows for texts without a letter."""
    out = np.full((len(texts), P), np.nan)
    for first, part in textvec.chunks(texts, 500_000):
        cps, begins = textvec.codepoints(part)
        k = np.minimum(cps, 0x3000)
        kind = _KIND[k]
        per = lambda mask: np.add.reduceat(mask, begins, dtype=np.int64).astype(float)
        lower, upper, space = per(kind == 1), per(kind == 2), per(kind == 4) - 1
        digit, odd = per(kind == 3), per((kind == 5) & ~_PLAIN[k])
        # digits are neither: a text is no worse for holding a number
        solid = np.diff(np.append(begins, len(cps))) - 1 - space - digit
        starts, _ = textvec.runs(kind != 4)
        words = np.bincount(np.searchsorted(begins, starts, "right") - 1, minlength=len(part)).astype(float)
        hashes, owner = textvec.word_hashes(part)
        n_words = np.bincount(owner, minlength=len(part)).astype(float)
        distinct = np.bincount((np.unique((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))) >> np.uint64(44)).astype(np.int64), minlength=len(part)).astype(float)
        lines = per(cps == 10)
        lines_seen = [len(set(t.split("\n"))) for t in part]
        letters = lower + upper
        x = np.stack(
            [
                np.log1p(words),
                np.log((letters + 20) / (n_words + 4)),
                _logit(letters, np.maximum(solid, letters), 20, 1),
                _logit(upper, letters, 1, 30),
                _logit(odd, np.maximum(solid, odd), 1, 20),
                np.log((distinct + 10) / (n_words + 10)) / np.log(n_words + 20),
                _logit(lines - lines_seen, lines, 0.5, 5),
                np.log((words + 20) / (lines + 1)),
            ],
            1,
        )
        x[letters == 0] = np.nan
        out[first : first + len(part)] = x
    return out


@F.arrow_udf(_VECTOR)
def _vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        x = vectors(texts.to_pylist())
        gone = np.isnan(x[:, 0])
        yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i]), mask=gone) for i in range(P)], X)


def chi2_quantile(q: float, df: int) -> float:
    """Wilson and Hilferty's approximation."""
    return df * (1 - 2 / (9 * df) + NormalDist().inv_cdf(q) * (2 / (9 * df)) ** 0.5) ** 3


def chi2_cdf(x: float, df: int) -> float:
    return NormalDist().cdf(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / (2 / (9 * df)) ** 0.5)


def consistency(alpha: float) -> float:
    """Factor that makes the covariance of the central share `alpha` one of the whole, for normal data."""
    return alpha / chi2_cdf(chi2_quantile(alpha, P), P + 2)


def _key(level: int) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    size = F.length(part("lang")).cast("string")
    return [F.concat(F.lit("g:"), size, F.lit(":"), part("lang"), part("source")), F.concat(F.lit("l:"), part("lang")), F.lit("t")][level]


M = [f"m{i}" for i in range(P)]
PREC = [f"p{k}" for k in range(len(_PAIRS))]
_SUM_COLUMNS = [f"s{i}" for i in range(P)] + [f"q{k}" for k in range(len(_PAIRS))]
_FIT = "key string, start int, n bigint, logdet double, " + ", ".join(f"{c} double" for c in M + PREC)
_I, _J = (np.array(x) for x in zip(*_PAIRS))


def _fitted(keys: np.ndarray, starts: np.ndarray, n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    cov = cov + np.diag(FLOOR**2)
    precision = np.linalg.inv(cov)[:, _I, _J] * np.where(_I == _J, 1, 2)
    head = pd.DataFrame({"key": keys, "start": starts.astype(np.int32), "n": n.astype(np.int64), "logdet": np.linalg.slogdet(cov)[1]})
    return pd.concat([head, pd.DataFrame(np.hstack([mean, precision]), columns=M + PREC)], axis=1)


def _moments(n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = sums[:, :P] / n[:, None]
    second = np.empty((len(n), P, P))
    second[:, _I, _J] = second[:, _J, _I] = sums[:, P:] / n[:, None]
    return mean, second - mean[:, :, None] * mean[:, None, :]


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """A partition's rows: at most a few hundred small ones for each group in it."""
    parts = [b for b in batches if len(b)]
    return pd.concat(parts, ignore_index=True) if parts else None


def _first_fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pdf = _whole(batches)
    if pdf is None:
        return
    n = pdf["n"].to_numpy(float)
    mean, cov = _moments(n, pdf[_SUM_COLUMNS].to_numpy(float))
    quartiles = np.stack([np.stack(pdf[f"u{i}"].to_list()) for i in range(P)], 1).astype(float)
    spread = np.maximum((quartiles[:, :, 2] - quartiles[:, :, 0]) / 1.349, FLOOR)
    keys = pdf["key"].to_numpy()
    yield _fitted(keys, np.zeros(len(n)), n, quartiles[:, :, 1], spread[:, :, None] ** 2 * np.eye(P))
    yield _fitted(keys, np.ones(len(n)), n, mean, cov)


def _refit(cut: float | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A concentration step (cut: None), or reweighting by the vectors within `cut`."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = _whole(batches)
        if pdf is None:
            return
        pdf = pdf.sort_values(["key", "start", "bucket"], ignore_index=True)
        by = pdf.groupby(["key", "start"], sort=False)
        total = by["n"].transform("sum").to_numpy(float)
        before = (by["n"].cumsum() - pdf["n"]).to_numpy(float)
        # the buckets up to the one that reaches the share; the nearest one in any case
        kept = pdf[before < np.ceil(ALPHA * total) if cut is None else (pdf["bucket"].to_numpy() <= bucket_of(cut)) | (before == 0)]
        sums = kept.groupby(["key", "start"], sort=False)[["n", *_SUM_COLUMNS]].sum()
        n = sums["n"].to_numpy(float)
        total = by["n"].sum().to_numpy(float)
        mean, cov = _moments(n, sums[_SUM_COLUMNS].to_numpy(float))
        share = np.clip(n / total, ALPHA if cut is None else 0.975, 0.999)
        keys = sums.index.get_level_values("key").to_numpy()
        yield _fitted(keys, sums.index.get_level_values("start").to_numpy(), total, mean, cov * np.array([consistency(x) for x in share])[:, None, None])

    return fit


def bucket_of(d2: float) -> int:
    return int(np.floor(8 * np.log2(d2 + 1e-3)))


def _sums() -> list[Column]:
    sums = ["count(*) as n", *(f"sum({x}) as s{i}" for i, x in enumerate(X)), *(f"sum({X[i]} * {X[j]}) as q{k}" for k, (i, j) in enumerate(_PAIRS))]
    return [F.expr(e) for e in sums]


def distance() -> Column:
    """Squared Mahalanobis distance of x0, x1, ... from the fit beside them."""
    centred = [f"({x} - {m})" for x, m in zip(X, M)]
    # row by row: x_i * (sum of p_ij x_j); the pairs' factor 2 is in p
    rows = [f"{centred[i]} * (" + " + ".join(f"{PREC[k]} * {centred[j]}" for k, (a, j) in enumerate(_PAIRS) if a == i) + ")" for i in range(P)]
    return F.expr(f"greatest({' + '.join(rows)}, 0D)")


def with_vectors(docs: DataFrame) -> DataFrame:
    return subset(docs, "doc_id", "lang", "source", "text").select("doc_id", "lang", "source", _vectors("text").alias("v")).select("doc_id", "lang", "source", "v.*")


def estimates(vectors_: DataFrame, steps: int = 4, min_group: int = 40) -> DataFrame:
    """(lang, source, n, m0..., p0...): the estimate that each (lang, source) is judged by; null where none is."""
    found = vectors_.filter("x0 is not null")
    levels = found.select("*", F.explode(F.array(*[_key(i) for i in range(3)])).alias("key"))
    first = levels.groupBy("key").agg(*_sums(), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"u{i}") for i, x in enumerate(X)])
    fits = written(first.mapInPandas(_first_fits, _FIT), "fits")
    tight = chi2_quantile(0.975, P)
    every = ["start", "n", "logdet", *M, *PREC]
    best = F.expr(f"min_by(struct({', '.join(every)}), struct(logdet, start)) as b")
    for step in range(steps + 1):
        last = step == steps
        if last:  # of each group the start with the smaller determinant
            fits = written(fits.groupBy("key").agg(best).select("key", "b.*"), "best")
        near = levels.join(fits, "key").withColumn("d2", distance()).select("key", "start", *X, F.floor(8 * F.log2(F.col("d2") + 1e-3)).cast("int").alias("bucket"))
        sums = near.groupBy("key", "start", "bucket").agg(*_sums()).repartition("key", "start")
        fits = written(sums.mapInPandas(_refit(tight if last else None), _FIT), "fits")
    groups = found.select("lang", "source").distinct().select("lang", "source", *[_key(i).alias(f"k{i}") for i in range(3)])
    for i in range(3):
        fit = fits.filter(F.col("n") >= min_group).select(F.col("key").alias(f"k{i}"), F.struct("n", *M, *PREC).alias(f"e{i}"))
        groups = groups.join(fit, f"k{i}", "left")
    return written(groups.select("lang", "source", F.coalesce("e0", "e1", "e2").alias("e")).select("lang", "source", "e.*"), "estimates")


def cut(quantile: float, slack: float) -> float:
    """Squared distance beyond which a vector is rejected: a chi-squared quantile, `slack` times as far."""
    return chi2_quantile(quantile, P) * slack**2


def _judged(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """rows has v.lang, v.source and x0...; adds d2 (null: no vector or no estimate)."""
    f = fits.select(F.col("lang").alias("fit_lang"), F.col("source").alias("fit_source"), *M, *PREC)
    return rows.join(f, F.col("lang").eqNullSafe(F.col("fit_lang")) & F.col("source").eqNullSafe(F.col("fit_source")), "left").withColumn("d2", F.when(F.col("m0").isNotNull() & F.col("x0").isNotNull(), distance())).drop("fit_lang", "fit_source", *M, *PREC)


def score(docs: DataFrame, quantile: float = 0.999, slack: float = 1.1, min_group: int = 40) -> DataFrame:
    """doc_id, lang, source, d2 and `rejected`, a row for each document."""
    vec = written(with_vectors(docs), "vectors")
    judged = _judged(vec, estimates(vec, min_group=min_group))
    return judged.select("doc_id", "lang", "source", "d2", (F.col("x0").isNull() | F.coalesce(F.col("d2") > cut(quantile, slack), F.lit(False))).alias("rejected"))


def keep_inliers(docs: DataFrame, quantile: float = 0.999, slack: float = 1.1, min_group: int = 40) -> DataFrame:
    """The rows of the documents that aren't rejected, all columns as they were.

    The vectors are computed again from the rows rather than joined to them,
    which saves a shuffle of all texts.
    """
    names = docs.columns
    fits = estimates(written(with_vectors(docs), "vectors"), min_group=min_group)
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col("lang"), F.col("source"), _vectors("text").alias("v")).select("row", "lang", "source", "v.*")
    return _judged(rows, fits).filter(F.col("x0").isNotNull() & F.coalesce(F.col("d2") <= cut(quantile, slack), F.lit(True))).select("row.*")
