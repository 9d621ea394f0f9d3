"""The corpus pipeline over a small folder, stage by stage."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    texts = docs.select("text").distinct().count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(out) == sizes[-1] and out.shard.between(0, 39).all() and texts <= sizes[3]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    toxic = set(labels.index[labels.toxic == 1])
    assert len(toxic & set(out.doc_id)) <= 0.5 * len(toxic)  # 87 labels teach the lexicon only in part


def test_near_duplicates_from_080(spark):
    """The stage against brute force at 0.8, on texts and their copies with one to three words changed."""
    r = random.Random(8)
    data = []
    for i in range(150):
        base = [f"w{r.randrange(5000)}" for _ in range(100)]
        copy = list(base)
        for j in range(1 + i % 3):
            copy[15 + 25 * j] = f"q{i}-{j}"
        data += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(96)} for i, t in data}
    share = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 300, 2)}
    assert sum(0.8 <= x < 0.85 for x in share.values()) >= 40 and any(x < 0.8 for x in share.values())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {row["doc_id"] for row in corpus_pipeline.deduplicate(spark, docs, SF).collect()}
    assert kept == set(range(0, 300, 2)) | {i + 1 for i, x in share.items() if x < 0.8}


EDGE = "doc_id long, text string, lang string, source string, n_chars long, turn int, id string, own string, e string, host string, row int, grp long"


def edge_rows():
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    same = text(40)
    data = [(i, text(30), "en", f"s{i % 3}") for i in range(30)] + [(i, same, "en", "s0") for i in range(100, 110)]
    data += [(200, None, None, None), (201, "", "en", "s1"), (None, text(20), "en", None), (None, None, None, None), (7, data[7][1], "en", "s1"), (300, text(30_000), "fr", "s2")]
    return [(*d, 1, 2, "x", "y", "z", "h", 3, 4) for d in data]


def test_every_stage_on_edge_rows(spark):
    """Nulls, empty and very long texts, copies, repeated rows, extra columns with the names of inner ones; and empty tables."""
    docs = spark.createDataFrame(edge_rows(), EDGE)
    want = {"quality": {d[0] for d in edge_rows()}, "near_duplicates": {d[0] for d in edge_rows()} - set(range(101, 110))}
    want["decontamination"] = want["near_duplicates"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "sharding":
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        got = [r["doc_id"] for r in docs.collect()]
        if name in want:
            assert set(got) == want[name] and got.count(7) == 2, name
        else:
            assert None in got and not {200, 201} & set(got)


def test_oracle_is_declared():
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
