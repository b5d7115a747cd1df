"""The pipeline over planted rows, stage by stage and as a whole."""

import random

import corpus_pipeline
from test_native import plain_contained, plain_extra, plain_mask
from trackloom.llm.neardup import shingle_set
from trackloom.llm.toxicity import score_toxicity


def planted(spark, path):
    rng = random.Random(1)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.randrange(4000)}" for _ in range(n))
    clean = {i: say(60) for i in range(100)}
    items = [(k, say(25)) for k in range(3)]
    docs = dict(clean)
    docs |= {200 + i: clean[i] for i in range(10)}
    docs |= {300 + i: clean[i] + " tail" for i in range(10)}
    docs |= {400 + k: f"{say(20)} {t} {say(20)}" for k, t in items}
    docs |= {500 + i: f"{say(20)} you idiot, pathetic moron {say(20)}" for i in range(10)}
    docs |= {600: say(20) + " password=hunter2222 " + say(3)}
    rows = [(i, t, "en", rng.choice(["a", "b"]), len(t)) for i, t in docs.items()] + [(700, None, None, None, None), (701, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(500 <= i < 510)) for i in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return clean


def plain_stages(rows, items, toxic):
    """What each stage keeps, (doc_id, text) by plain loops; the toxicity model's verdicts are given."""
    rows = [r for r in rows if r[0] not in toxic]
    yield rows
    sets = [set(shingle_set(t, 5).tolist()) for _, t in rows]
    least = list(range(len(rows)))
    for _ in rows:  # labels spread until nothing changes
        before = list(least)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    least[i] = least[j] = min(least[i], least[j], key=lambda k: rows[k][0])
        if least == before:
            break
    rows = [r for k, r in enumerate(rows) if r[0] == rows[least[k]][0]]
    yield rows
    bad = {i for i, _ in plain_contained(rows, items)}
    rows = [r for r in rows if r[0] not in bad]
    yield rows
    rows = [(i, t and plain_mask(t, plain_extra(t))) for i, t in rows]
    yield rows
    yield rows


def test_stages_by_brute_force(spark, tmp_path):
    planted(spark, str(tmp_path))
    path = str(tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    scores = score_toxicity(docs, spark.read.parquet(f"{path}/labels.parquet"))
    toxic = {r.doc_id for r in scores.filter("predicted = 1").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    rows, sources = [(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r.source for r in docs.collect()}
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_stages(rows, items, toxic)):
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/brute-{name}")
        docs = spark.read.parquet(f"{path}/brute-{name}")
        got = docs.collect()
        if name != "mixing":
            assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, t or "") for i, t in want), name
            assert {r.doc_id: r.source for r in got} == {i: sources[i] for i, _ in want}
    sizes, taken = {}, {}
    for i, t in want:
        sizes[sources[i]] = sizes.get(sources[i], 0) + len((t or "").split())
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    # a, b and null weigh 1, 2, 3; null has no words and b takes three times its size at most
    total = sum(sizes.values())
    b = min(total * 2 / 3, 3 * sizes["b"])
    assert taken == {"a": round(min(3 * sizes["a"], total - b)), "b": round(b)}
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, path).collect())


def test_planted_rows(spark, tmp_path):
    clean, path = planted(spark, str(tmp_path)), str(tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
            assert set(clean) <= set(seen[name])
    gone = lambda name, lo, hi: not any(lo <= i < hi for i in seen[name])
    assert gone("toxicity", 500, 510) and not gone("toxicity", 200, 310)
    assert gone("near_duplicates", 200, 310) and {700, 701} <= set(seen["near_duplicates"])
    assert gone("decontamination", 400, 403) and not gone("near_duplicates", 400, 403)
    assert "[secret]" in seen["secrets"][600].text and "hunter" not in seen["secrets"][600].text and seen["secrets"][600].n_chars == len(seen["secrets"][600].text)
    assert all(0 < r.taken <= 3 * r["size"] for r in seen["mixing"].values())
    whole = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, path).collect()}
    assert whole == {i: r.taken for i, r in seen["mixing"].items()}
