"""The stages of the pipeline on a small corpus: each against what its operator's own brute force says."""

import random

import corpus_pipeline as C

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _corpus(spark, folder, prose):
    rnd, rows, labels = random.Random(5), [], []
    shared = prose(70, 1)
    for i in range(400):
        text = prose(rnd.randint(60, 120), 9000 + i)
        if i % 8 == 0:
            text = f"{text} grobian {prose(5, i)} grobian"
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        rows.append((i, text))
    clean = [r for r in rows if r[0] % 8]
    rows += [(1000, clean[0][1]), (1001, clean[1][1] + " more"), (1002, prose(30, 71) + " " + shared), (1003, prose(30, 72) + " " + shared + " end")]
    rows += [(1004, prose(20, 73) + " pass" + "word=q7R2xL9vT4bN8mK1"), (1005, ""), (1006, None), (None, "no id")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, clean


def test_stages(spark, tmp_path, prose):
    rows, clean = _corpus(spark, tmp_path, prose)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == COLUMNS
            kept[name] = {r.doc_id: r for r in docs.collect()}
            assert all(r.n_chars == len(r.text or "") for r in kept[name].values() if r.text is not None)
    ids = {i for i, _ in rows}
    assert ids - set(kept["toxicity"]) == {i for i in range(0, 400, 8)}
    assert set(kept["toxicity"]) - set(kept["near_dedup"]) == {1000, 1001}
    before, after = kept["near_dedup"], kept["substring_dedup"]
    assert {i for i in before if before[i].text != after[i].text} == {1003} and after[1003].text.split()[-1] == "end" and len(after[1003].text.split()) == 31
    assert {i for i in after if after[i].text != kept["secrets"][i].text} == {1004} and kept["secrets"][1004].text.endswith("[SECRET]")
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == set(kept["secrets"])


def test_run_and_names(spark, tmp_path, prose):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "secrets", "packing"] and C.ORACLE_SQL is None
    _corpus(spark, tmp_path, prose)
    assert C.run(spark, str(tmp_path)).count() > 300


def test_rows_of_one_id(spark, prose):
    texts = [prose(60, 1), prose(60, 2), prose(60, 3)]
    rows = [(1, texts[0], "en", "b"), (1, texts[0], "en", "a"), (1, texts[0], "fr", "a"), (1, texts[1], "en", "b"), (2, texts[2], "en", "s"), (3, texts[2], "en", "s"), (4, None, "en", "s"), (4, None, "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text, r.lang, r.source) for r in C.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, texts[0], "en", "a"), (1, texts[1], "en", "b"), (2, texts[2], "en", "s"), (4, None, "en", "s")], key=str)


def test_empty_tables_and_odd_rows(spark, tmp_path, prose):
    """No rows, no labels, nulls, empty and very long texts, repeated rows, and columns with names of the stages' own."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("none", "odd"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0
    same, long = prose(80, 5), " ".join(prose(300, i) for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, same), (6, same), (6, same), (None, same), (None, None), (7, long)]
    odd = spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1, "y") for i, t in rows], f"{ddl}, _score string, _digest int, first string")
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs = odd
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd")
        assert docs.columns == COLUMNS
        docs.write.parquet(f"{tmp_path}/step")
        docs = spark.createDataFrame(spark.read.parquet(f"{tmp_path}/step").collect(), ddl)
        spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/step"), True)
    assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted([1, 2, 3, 4, 5, 7, None, None], key=str)
    pieces = C.run(spark, f"{tmp_path}/odd").collect()
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert tokens[1] == tokens[2] == 1 and sum(p.length for p in pieces if p.doc_id == 7) == tokens[7] > 20_000
