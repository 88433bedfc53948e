"""What keeps steps bounded on larger tables: one pass over the inputs, small slices, no products of groups."""

from __future__ import annotations

import pyarrow as pa

from navspark.operators import match


def wanted_of(spark, phrases):
    rows = [(q, 0, place, t, prefix and place == len(words) - 1, len(words)) for q, words, prefix in phrases for place, t in enumerate(words)]
    return spark.createDataFrame(rows, "query long, phrase int, place int, term string, prefix boolean, size int")


def test_phrases_read_the_index_once(spark):
    """Hits equal a loop's, over rows that run on across batches, and the index is scanned once."""
    texts = {i: " ".join("ab"[(i * k) % 3 % 2] + "xyz"[(k * k + i) % 3] * (k % 3) for k in range(60)) for i in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "doc long, text string")
    asked = [(1, ["ax", "b"], False), (2, ["ax", "b"], False), (3, ["b", "ay"], True), (4, ["a"], True), (5, ["bz", "axx", "a"], False), (6, ["a"], False)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = match.phrase_hits(match.positional(rows, ["doc"], ["text"]), ["doc"], wanted_of(spark, asked))
        found = {(r["query"], r["doc"]): r["hits"] for r in got.collect()}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for doc, text in texts.items():
        words = text.split()
        for q, phrase, prefix in asked:
            fits = lambda at: words[at : at + len(phrase) - 1] == phrase[:-1] and at + len(phrase) <= len(words) and (words[at + len(phrase) - 1].startswith(phrase[-1]) if prefix else words[at + len(phrase) - 1] == phrase[-1])  # noqa: B023, E731
            if n := sum(fits(at) for at in range(len(words))):
                want[q, doc] = n
    assert found == want
    assert plan.count("positions#") and sum("MapInArrow run(" in line and "text_0" in line for line in plan.splitlines()) == 1


def test_texts_are_taken_apart_in_slices():
    """A batch's texts are never all in a worker's lists at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["word " * 4000] * 299 + [None])], ["k", "text"])
    parts = list(match.slices(iter([batch]), [1]))
    assert max(p.num_rows for p in parts) * 20_000 <= match.SLICE
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(300))


def test_bm25_shuffles_no_pairs(spark):
    """The best of each query equal a loop's, with rows that repeat a key, ties and null texts, and no pair of query and row is shuffled."""
    import math
    from collections import Counter

    from navspark.operators import text_index

    texts = [(i, " ".join("abcdefgh"[(i * k * k + k) % (3 + i % 6)] for k in range(5 + i % 9))) for i in range(60)]
    texts += [(5, "a b"), (5, "a c"), (60, None), (61, ""), (62, texts[7][1])]
    queries = [(q, t) for q, words in enumerate(["a b", "c", "h a g", "none", "b"]) for t in words.split()]
    docs = spark.createDataFrame(texts, "doc long, text string")
    made = text_index.best_matches(docs, spark.createDataFrame([*queries, queries[0]], "query long, term string"), "doc", "query", 5)
    got = sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in made.collect())
    parts: dict[tuple[int, int], Counter] = {}
    for doc, text in texts:
        words = (text or "").split()
        parts.setdefault((doc, len(words)), Counter()).update(words)
    df = Counter(t for found in parts.values() for t in found)
    average = sum(len((text or "").split()) for _, text in texts) / len(texts)
    want = []
    for q in range(5):
        scores: dict[int, float] = {}
        for (doc, length), found in parts.items():
            for t in (t for p, t in queries if p == q and t in found):
                weight = max(0.0, math.log((len(texts) - df[t] + 0.5) / (df[t] + 0.5))) or 1e-6
                scores[doc] = scores.get(doc, 0.0) + weight * found[t] * 2.2 / (found[t] + 1.2 * (0.25 + 0.75 * length / average))
        want += [(q, n + 1, doc, round(s, 6)) for n, (doc, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5])]
    assert got == want
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1  # each task's best


def test_percentiles_of_a_group_are_dealt_out(spark):
    """Exact ranks over groups of one row, of nulls only and with a null name; no task holds a group's values."""
    from navspark.operators import relational

    rows = [("a", float((i * 37) % 101)) for i in range(1000)] + [("b", 1.5), ("c", None), (None, 2.0), (None, None), (None, 3.0)]
    made = relational.percentiles_by(spark.createDataFrame(rows, "g string, v double"), "g", "v", (50, 90, 95, 99))
    want = {}
    for g in {g for g, _ in rows}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = [values[max(1, -(-len(values) * p // 100)) - 1] if values else None for p in (50, 90, 95, 99)]
    assert {r["g"]: [r[f"p{p}"] for p in (50, 90, 95, 99)] for r in made.collect()} == want
    assert "percentile" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_given_in_slices():
    """A worker never gives the chunks of more than a few hundred files at once."""
    import pandas as pd

    from navspark.operators import structure

    class Files:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            return run

    given = pd.DataFrame({"path": [str(i) for i in range(1200)], "language": "txt", "text": "a\nb"})
    parts = list(structure.structured_chunks(Files())(iter([given])))
    assert max(p["path"].nunique() for p in parts) <= 512
    assert pd.concat(parts)["path"].tolist() == given["path"].tolist()


def test_components_shrink_with_every_round(spark, monkeypatch):
    """Classes equal a loop's, also those without a doc_id, and all rounds together read little more edges than there are."""
    import random

    from navspark.llm import minhash

    draw = random.Random(5)
    names = [bytes([k // 256, k % 256]) for k in range(600)]
    reps = {s: minhash.LARGEST if k % 10 == 0 else (k * 37) % 601 for k, s in enumerate(names)}
    pairs = [(names[300], s) for s in names[250:420:2]] + [(s, names[311]) for s in names[251:420:2]] + list(zip(names[:200], names[1:], strict=False))
    pairs += [(a, b) for a, b in (draw.sample(names[420:], 2) for _ in range(80))] + [(names[210], names[220]), (names[230], names[231])]
    root = {s: s for s in names}

    def of(s):
        return s if root[s] == s else of(root[s])

    for a, b in pairs:
        root[of(a)] = of(b)
    linked = {s for p in pairs for s in p}
    want = {s: min(reps[t] for t in linked if of(t) == of(s)) for s in linked}
    rows, keep = [], minhash.written

    def counted(df, label):
        out = keep(df, label)
        if label == "near-links":
            rows.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    found = minhash.components(spark.createDataFrame(list(reps.items()), "sid binary, rep long"), spark.createDataFrame(pairs, "a binary, b binary"))
    assert {bytes(r["sid"]): r["label"] for r in found.collect()} == want
    assert sum(rows) <= 1.6 * len(pairs)


def test_update_takes_texts_once(spark, tmp_path, monkeypatch):
    """An update reads its files for sizes, changes and texts only, whatever number of tables it makes; with paths that don't fit a broadcast it stores what an index made at once does."""
    from navspark.sources import stored_index
    from navspark.sources.stored_index import TABLES, StoredIndex

    monkeypatch.setattr(stored_index, "PATHS_AT_ONCE", 4, raising=False)
    monkeypatch.setattr(stored_index, "PIECE_BYTES", 200, raising=False)
    seen = spark.sparkContext.accumulator(0)

    def files(rows):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        made = spark.createDataFrame([(p, t, p.rsplit(".")[-1], len(t), t[:9] + str(len(t)), 0.0) for p, t in rows], "path string, text string, language string, size long, hash string, modified_ms double")
        return made.mapInPandas(run, made.schema)

    first = [(f"a/f{i}.py", f"from a.f{i + 1} import x\n\nclass C{i}:\n    pass\n" * (1 + i % 3)) for i in range(40)]
    later = [(p, t + "# more\n" * (i % 2)) for i, (p, t) in enumerate(first) if i % 5] + [("b/new.py", "import a.f1\n")]
    index, whole = StoredIndex(spark, str(tmp_path / "one")), StoredIndex(spark, str(tmp_path / "two"))
    assert index.update(files(first))["indexed"] == 40
    assert seen.value <= 3 * 40
    assert index.update(files(later)) == {"indexed": 17, "removed": 8, "version": 2}
    assert seen.value <= 3 * 40 + 2 * 33
    whole.update(files(later))
    for name in TABLES:
        rows = lambda i: sorted(map(str, i.table(name).drop("indexed_at").collect()))  # noqa: B023, E731
        assert rows(index) == rows(whole)
        assert rows(index) or name in ("edges", "references")
    assert not list(tmp_path.glob("*/data/*/texts"))


def test_users_share_a_state(spark, tmp_path, monkeypatch):
    """Reminders of many users in two groups equal the batch's; calls follow the groups, not the users."""
    import datetime

    from navspark.streaming import reminders
    from navspark.streaming.usage_stream import append_available

    monkeypatch.setattr(reminders, "GROUPS", 2)
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(i, at((i * 17) % 400), i % 50, ("view", "click", "purchase", "error")[i * 7 % 4]) for i in range(600)] + [(600, at(9000), 1, "view")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    events.write.parquet(f"{tmp_path}/in")
    stream = reminders.reminders(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    groups = spark.createDataFrame([(u,) for u in range(50)], "u long").selectExpr("pmod(hash(u), 2) as g").distinct().count()
    assert groups == 2
    with reminders.rocks(spark):
        got = sorted(map(str, append_available(stream, f"{tmp_path}/run").collect()))
    assert got == sorted(map(str, reminders.reminders(events).where("last < '2024-01-03'").collect())) and len(got) > 50
