from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listwright.llm import jaccard, lines
from listwright.llm.common import materialize
from listwright.llm.components import components
from listwright.llm.jaccard import jaccard_components, link_sets, ngram_sets, suffix_bound
from tests.conftest import SF


def brute_dedup(rows, words):
    """Later copies of runs with enough words, by comparing all runs."""
    docs = sorted({(k is not None, k or 0, t) for k, t in rows if t is not None}, key=lambda x: x[:2])
    parts = [[(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")] for _, _, t in docs]
    seen, gone = {}, [set() for _ in docs]
    for d, some in enumerate(parts):
        for a in range(len(some)):
            for b in range(a, len(some)):
                run = tuple(x for _, x in some[a : b + 1])
                if sum(len([w for w in x.split(" ") if w]) for x in run) >= words:
                    if seen.setdefault(run, (d, a)) != (d, a):
                        gone[d] |= {i for i, _ in some[a : b + 1]}
    out = {}
    for (known, k, t), cut in zip(docs, gone, strict=True):
        out[k if known else None, t] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut) if cut else t
    return out


def check_dedup(spark, rows, words, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    want = brute_dedup(rows, words)
    got = Counter((r["doc_id"], r["text"]) for r in lines.dedup_lines(df, words).collect())
    assert got == Counter((k, None if t is None else want[k, t]) for k, t in rows)


def test_line_runs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = ["alpha", "beta gamma", "one two three", "  padded line ", "", " ", "x y z u v", "lone"]
    rows = [(k, "\n".join(rng.choice(pool, rng.integers(0, 14)))) for k in range(30)]
    rows += [(100 + k, rows[k][1] + "\nonly here " + str(k)) for k in range(6)] + [(200, rows[3][1]), (None, None), (201, ""), (None, rows[4][1])]
    rows += [(300, "\n".join(["same words"] * 25)), (301, "\n".join(["same words"] * 9)), (302, None)]
    rows = [(k, f"{t}\nend {k}" if k is not None and t and k < 100 else t) for k, t in rows]
    for words in (1, 4, 9):
        check_dedup(spark, rows, words)


def test_repeated_rows_are_one_document(spark):
    text = "a b c\nd e f"
    rows = [(1, text), (1, text), (1, text), (2, text)]
    got = Counter((r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == {(1, text): 3, (2, ""): 1}


def test_long_runs_double_often(spark):
    text = "\n".join(f"w{k}" for k in range(300))
    rows = [(1, text), (2, "before\n" + text + "\nafter"), (3, "\n".join(text.split("\n")[40:140]))]
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 60, removed="gone").collect()}
    assert got == {1: (text, 0), 2: ("before\nafter", 300), 3: ("", 100)}


def test_awkward_lines(spark, awkward, nothing):
    out = lines.dedup_lines(awkward.withColumnRenamed("part", "d").withColumnRenamed("n", "h"), removed="spans")
    assert out.count() == awkward.count() and set(out.columns) == {"doc_id", "text", "spans", "h", "score", "d"}
    assert Counter(r["text"] for r in out.collect()) == Counter(r["text"] for r in awkward.collect())
    assert lines.dedup_lines(nothing).count() == 0


def test_no_python_in_line_dedup(spark, docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def sets_of(texts, n):
    out = []
    for text in texts:
        w = (text or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows, n, percent):
    sets = sets_of([t for _, t in rows], n)
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and group[x] != group[y]:
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    ids = {g: min((k for k, _ in (rows[j] for j in range(len(rows)) if group[j] == g) if k is not None), default=None) for g in group}
    return Counter((k, len(s), ids[g] if s else k) for (k, _), s, g in zip(rows, sets, group, strict=True))


def near_copies(seed, n):
    """Groups of texts with a few words changed, in sizes from two to many."""
    rng = np.random.default_rng(seed)
    words, rows = [f"w{k}" for k in range(400)], []
    for size in (1, 2, 3, 5, 40):
        first = list(rng.choice(words, rng.integers(20, 90)))
        for _ in range(size):
            text = [str(rng.choice(words)) if rng.random() < 0.02 else x for x in first]
            rows.append(" ".join(text if rng.random() < 0.7 else first))
    rows += ["", "  \n", "one", "ONE", "one two", "One\ttwo", " ".join(rows[-1].split(" ")[:-2])]
    return [(int(k), rows[j]) for k, j in zip(rng.permutation(len(rows)), range(len(rows)), strict=True)]


@pytest.mark.parametrize("part, percent, n", [(10**6, 85, 4), (150, 80, 5)])
def test_components_equal_brute_force(spark, monkeypatch, part, percent, n):
    monkeypatch.setattr(jaccard, "PART_NGRAMS", part)
    rows = [*near_copies(part % 97, n), (None, "one two"), (7, "another text with the same number"), (7, "another text with the same number"), (None, None)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, n, percent)


def mosaic(docs, seed=3):
    """Texts put together from paragraphs that others hold as well, none like another; the paragraphs grow with the texts."""
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(docs)]
    return [(k, " ".join(pool[j] for j in rng.choice(docs, 5, replace=False))) for k in range(docs)]


def test_shared_paragraphs_are_compared_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_NGRAMS", 3_000)
    seen = []

    def spy(pairs, *rest):
        seen[-1] += pairs.count()
        return verify(pairs, *rest)

    verify = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", spy)
    for size in (150, 300):
        seen.append(0)
        rows = mosaic(size)
        rows += [(size + k, t.rsplit(" ", 3)[0]) for k, t in rows[:20]]
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80)
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 5, 80)
    assert 0 < seen[0] and seen[1] < 3 * seen[0]


def test_several_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_NGRAMS", 2_000)
    rng = np.random.default_rng(9)
    start = [f"s{k}" for k in range(40)]
    rows = []
    for g in range(3):
        own = start + [f"g{g}w{k}" for k in range(40)]
        for _ in range(60):
            text = list(own)
            text[rng.integers(80)] = f"x{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(text)))
    rows += rows[:30] * 2
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 80)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 4, 80)


def test_a_common_shingle_is_sent_once_a_batch(spark):
    rows = [(k, f"the same five words here and then own{k} more{k} text{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    largest = max(len(r["payload"]) + len(r["many"]) for r in jaccard.dealt(df, 5, 8).where("bucket >= 0").collect())
    assert largest < 400


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(6)
    for percent in (50, 80, 100):
        base = [rng.choice(200, 40, replace=False) for _ in range(4)]
        sets = [np.unique(np.where(rng.random(40) < 0.15, rng.integers(200, size=40), base[k % 4])).astype(np.uint64) for k in range(80)]
        links = link_sets(sets, percent)
        group = list(range(80))
        for a, b in links:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
            group = [group[b] if g == group[a] else g for g in group]
        for a in range(80):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    assert group[a] == group[b]


def test_suffix_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(500):
        x, y = (np.unique(rng.integers(60, size=rng.integers(0, 30))) for _ in range(2))
        assert suffix_bound(x, y, 100) <= len(np.setxor1d(x, y))


def test_ngrams():
    texts = ["a b c d e", "A B\nC\td  e", "a b", "a  B", "", "b a", "É x y z", "é x y z"]
    for got, want in zip(ngram_sets(texts, 4), sets_of(texts, 4), strict=True):
        assert len(got) == len(want)
    one, two, three, four, _, six, seven, eight = (x.tolist() for x in ngram_sets(texts, 4))
    assert one == two and three == four and three != six and seven != eight


def test_components(spark):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(400, size=(300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    group = {}
    for a, b in links:
        if a != b:
            x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
            if x is not y:
                x |= y
                for k in y:
                    group[k] = x
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert found == {k: min(x) for k, x in group.items()}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_awkward_jaccard(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    got = jaccard_components(awkward, 5, 80)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 5, 80)
    assert jaccard_components(nothing).count() == 0


def test_jaccard_query(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in jaccard.op7_jaccard(spark, SF).collect()) == brute_components(rows, 4, 85)


@pytest.fixture(scope="module")
def stages(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def test_pipeline_stages(spark, stages):
    from listwright.llm import decontamination, packing, quality

    raw, good, shorter, single, clean, packed = stages
    assert all(x.columns == raw.columns for x in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    model = quality.fit_quality(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = raw.collect()
    scores = model.score([r["text"] or "" for r in rows])
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD}
    connection = duckdb.connect()
    good_rows = good.toPandas()  # noqa: F841  (DuckDB reads it by name)
    want = dict(connection.execute(f"SELECT doc_id, text FROM ({lines.line_dedup_sql("good_rows", 'doc_id')})").fetchall())
    assert {r["doc_id"]: r["text"] for r in shorter.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in shorter.collect())
    ids = brute_components([(r["doc_id"], r["text"]) for r in shorter.collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {c for _, _, c in ids}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontamination.contaminated(single, bench).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - hit
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    assert packing.BINS > 1


def test_pipeline_run(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter(
        map(tuple, stages[-1].select("doc_id", "piece", "length", "ids_crc32").collect())
    )


def test_stages_on_awkward_tables(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = materialize(stage(spark, docs, SF), name)
            if name != "best_fit_packing":
                assert docs.columns == before.columns
        assert docs.isEmpty() == before.isEmpty()


def test_one_row_of_each_group_stays(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(400)], 30)) for _ in range(6)]
    near = texts[0].rsplit(" ", 1)[0] + " other"
    rows = [(1, texts[0], k % 7) for k in range(60)] + [(8, texts[0], 0), (9, near, 0), (9, near, 1)]
    rows += [(None, texts[1], k) for k in (3, 2, None)] + [(None, texts[2], 1), (2, texts[2], 6), (2, texts[2], 5)]
    rows += [(3, texts[3], 1), (3, texts[4], 1), (4, texts[5], None), (4, texts[5], None)]
    blank = [(None, None, 1), (None, None, 1), (5, "", 1), (5, "", 1), (5, " \n", 2)]
    docs = spark.createDataFrame(rows + blank, "doc_id long, text string, n long").repartition(5)
    docs = docs.withColumn("tags", F.create_map(F.lit("n"), "n")).select("tags", "doc_id", "n", "text")
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, SF)
    assert got.schema.simpleString() == docs.schema.simpleString()
    want = [(1, texts[0], 0), (None, texts[1], None), (2, texts[2], 5), (3, texts[3], 1), (3, texts[4], 1), (4, texts[5], None), *blank]
    assert Counter((r["doc_id"], r["text"], r["n"]) for r in got.collect()) == Counter(want)
    assert all(r["tags"] == {"n": r["n"]} for r in got.collect())


def test_a_table_loaded_twice_gives_the_same_rows(spark, stages):
    single = stages[3]
    got = corpus_pipeline.ngram_jaccard_join(spark, stages[2].unionByName(stages[2]), SF)
    wordless = Counter(tuple(r) for r in single.collect() if not (r["text"] or "").encode().split())
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in single.collect()) + wordless
