"""The pipeline's stages on a small corpus, each against what its operator says."""

import random

import corpus_pipeline as P


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(240):
        w = [word() for _ in range(80)]
        if i % 8 == 0:
            w.insert(3, "vile")
            w.insert(9, "vile")
        rows.append((i, " ".join(w), int(i % 8 == 0)))
    rows.append((300, rows[1][1], 0))  # a copy
    rows += [(301 + k, " ".join(word() for _ in range(200)) + " " + passage, 0) for k in range(2)]
    rows += [(310, 'clean token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" text', 0), (311, None, 0), (312, "", 0)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(P.STAGES):
            assert docs.columns == P.COLUMNS
            seen.append({r.doc_id: r.text for r in docs.collect()})
    clean = {i for i, _, y in rows if not y}
    assert clean == set(seen[0])
    assert set(seen[1]) == clean - {300} and seen[1][1] == rows[1][1]
    assert set(seen[2]) == set(seen[1]) and passage not in seen[2][301] and len(seen[2][301].split()) == 200 and seen[2][2] == rows[2][1]
    assert seen[3][310] == 'clean <assign>" text' and seen[3][2] == rows[2][1]
    assert {r.doc_id for r in docs.collect()} == set(seen[3])
    assert P.run(spark, str(tmp_path)).count() == docs.count()
