import itertools

import brute
import pytest

from lignum.llm import sharding


def curve(point, bits=sharding.BITS, n=sharding.DIMS):
    digit, follow = sharding.curve_tables(n)
    state = index = 0
    for level in range(bits - 1, -1, -1):
        b = sum((point[k] >> level & 1) << (n - 1 - k) for k in range(n))
        index, state = index * (1 << n) + digit[state * (1 << n) + b], follow[state * (1 << n) + b]
    return index


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_touch(n, bits):
    points = {curve(p, bits, n): p for p in itertools.product(range(1 << bits), repeat=n)}
    assert sorted(points) == list(range(1 << bits * n))
    for a, b in itertools.pairwise(points[k] for k in range(len(points))):
        assert sum(abs(x - y) for x, y in zip(a, b)) == 1


def brute_shard(rows, run_chars):
    """{(row index): (curve_index, run_id)}"""
    first = lambda v: (v is not None, v or "")
    level = lambda values: {v: k * sharding.LEVELS // len(values) for k, v in enumerate(sorted(values, key=first))}
    lang, source = level({r[2] for r in rows}), level({r[3] for r in rows})
    at = [curve((lang[r[2]], source[r[3]], sum((r[4] or 0) >= t for t in sharding.LENGTHS))) for r in rows]
    size = {}
    for c, r in zip(at, rows):
        size[c] = size.get(c, 0) + (r[4] or 0)
    upto, runs = 0, {}
    for c in sorted(size):
        begin, upto = upto, upto + size[c]
        runs[c] = (begin // run_chars, max(1, upto // run_chars - begin // run_chars))
    return [(c, runs[c][0] + brute.order_hash(r[0], "shard") % runs[c][1]) for c, r in zip(at, rows)]


@pytest.mark.parametrize("run_chars", [10_000, sharding.RUN_CHARS])
def test_equals_brute_force(docs, odd, odd_rows, run_chars):
    for df in (docs, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        got = sharding.shard(df, run_chars)
        carried = [c for c in df.columns if c not in ("curve_index", "run_id")]
        assert got.columns == [*carried, "curve_index", "run_id"]
        want = sorted(map(repr, (r + x for r, x in zip(rows, brute_shard(rows, run_chars)))))
        found = got.collect()
        assert sorted(repr(tuple(r)[:5] + tuple(r)[-2:]) for r in found) == want
        assert all(r[c] == "mine" for r in found for c in carried[5:])


def test_sql_twin(odd, duck):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    key = lambda r: repr((r["doc_id"], r["lang"], r["source"], r["n_chars"], r["curve_index"], r["run_id"]))
    assert sorted(map(key, duck(sharding.shard_sql(run_chars=1000), plain))) == sorted(key(r) for r in sharding.shard(plain, 1000).collect())


def test_runs_are_sorted_and_prune(docs, tmp_path, spark):
    runs = sharding.shard(docs, 20_000)
    for part in runs.rdd.glom().collect():
        assert part == sorted(part, key=lambda r: (r.run_id, r.curve_index, r.doc_id))
    manifest = {r.run_id: r for r in sharding.manifest(runs).collect()}
    sharding.write_runs(runs, str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert back.count() == docs.count() and {int(p.name.split("=")[1]) for p in (tmp_path / "runs").glob("run_id=*")} == set(manifest)
    # a filter on each dimension skips runs, and misses no row
    for name, low, high in (("lang", "de", "de"), ("n_chars", 0, 100)):
        files = [k for k, m in manifest.items() if m[f"min_{name}"] <= high and m[f"max_{name}"] >= low]
        hits = back.filter(f"{name} between '{low}' and '{high}'" if name == "lang" else f"{name} between {low} and {high}")
        assert len(files) < 0.9 * len(manifest) and {r.run_id for r in hits.select("run_id").distinct().collect()} <= set(files)


def test_empty(no_docs):
    assert sharding.shard(no_docs).collect() == []


def test_a_task_for_each_run(docs, monkeypatch):
    runs = sharding.shard(docs, 20_000)
    n = runs.rdd.getNumPartitions()
    parts = [{r.run_id for r in part} for part in runs.rdd.glom().collect()]
    assert n > 8 and all(len(p) <= 1 for p in parts)
    monkeypatch.setattr(sharding, "TASKS", 4)
    parts = [{r.run_id for r in part} for part in sharding.shard(docs, 20_000).rdd.glom().collect()]
    assert len(parts) == 4 and all(parts) and not any(a & b for a, b in itertools.combinations(parts, 2))
