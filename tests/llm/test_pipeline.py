"""The pipeline's stages against plain Python on a small corpus."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_secrets import brute as secret_spans
from tests.llm.test_toxicity import made


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_match_plain_python(spark, tmp_path):
    rng = random.Random(17)
    labelled = list(made(500, 5))
    some = ["p%d" % i for i in range(500)]
    clean = [" ".join(rng.choice(some) for _ in range(rng.randint(40, 150))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(some) for _ in range(30))) for i in range(4)]
    texts = [t for _, t, _ in labelled] + clean + clean[:10] + [clean[11] + " tail", clean[12] + " ende", clean[5] + " " + items[1][1], items[2][1].upper().lower(), "password: hunter2222 " + clean[20][:80], None, "", ""]
    ids = list(range(len(texts)))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)] + [(len(labelled), clean[0], "en", "s", len(clean[0]))]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{k}.parquet")
        docs = spark.read.parquet(f"{sf}/{k}.parquet")
        kept[name] = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
    toxic = {i for i, _, y in labelled if y}
    after = {i for i, _, _ in kept["toxicity"]}
    assert not toxic & after or len(toxic & after) < 0.03 * len(toxic)
    assert set(range(len(labelled), len(texts))) <= after and len(after & set(range(len(labelled))) - toxic) >= 0.98 * (len(labelled) - len(toxic))

    first = {}
    for i, t, _ in sorted(kept["toxicity"]):
        s = shingles(t)
        copy = next((j for j, x in first.items() if s and len(s & x) >= 0.8 * len(s | x)), None)
        if copy is None:
            first[i] = s
    assert sorted(i for i, _, _ in kept["simhash_near_dedup"]) == sorted(first)

    bad = {d for d, _ in leaks([(i, t) for i, t, _ in kept["simhash_near_dedup"]], items)}
    assert len(bad) == 2 and sorted(i for i, _, _ in kept["decontamination"]) == sorted(set(first) - bad)

    before = {i: t for i, t, _ in kept["decontamination"]}
    assert {i for i, _, _ in kept["secret_scans"]} == set(before)
    for i, t, n in kept["secret_scans"]:
        assert (t == before[i]) == (not secret_spans(before[i])) and n == len(t or "")
    assert sum("[SECRET]" in (t or "") for _, t, _ in kept["secret_scans"]) == 1

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    final = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in final) == sorted(before)
    at = {i: t for i, t, _ in kept["secret_scans"]}
    for r in final:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(at[r.doc_id] or "", add_special_tokens=False).ids and r.text == (at[r.doc_id] or "")


def test_rows_of_one_id_are_judged_apart(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 999)) for _ in range(n))
    a, b, c, item = text(80), text(80), text(60), text(30)
    long = text(20_000)
    rows = [(3, a), (7, a), (7, b), (8, c), (8, c), (8, c + " " + item), (None, c + " " + item), (None, b), (9, long), (10, long + " end"), (9, None)]
    sf = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as _met_id", "2 as held", "3 as row_key", "4 as key", "5 as sid", "6 as first")
    once = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert once.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=repr) == sorted([(3, a), (7, b), (8, c), (8, c + " " + item), (None, c + " " + item), (None, b), (9, long), (9, None)], key=repr)
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted([(i, t) for i, t in rows if item not in (t or "")], key=repr)
    masked = corpus_pipeline.mask_secrets(spark, docs.withColumn("text", F.concat(F.lit("password: hunter2222 "), "text")), sf)
    assert masked.columns == docs.columns and all(r.spans == "x" and (r.text is None or r.text.count("[SECRET]") == 1) for r in masked.collect())
