from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from friction.llm.common import read_table
from friction.llm.exact_dedup import exact_dedup
from friction.llm.mixing import mix
from friction.llm.packing import id_type, pack
from friction.llm.token_counts import VOCABULARY, encoding
from friction.llm.near_copies import drop_similar
from friction.llm.toxicity import toxicity


def test_each_stage_does_what_its_operator_decides(spark, sf, tmp_path):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    decide = [
        lambda d: ids(toxicity(d, labels).where("not toxic")),
        lambda d: ids(exact_dedup(d).where("kept")),
        lambda d: ids(drop_similar(d)),  # held against all pairs in test_near_copies.py
        lambda d: sorted(Counter({r.doc_id: r.copies for r in mix(d).collect()}).elements()),
        lambda d: sorted(r.doc_id for r in pack(d).collect()),
    ]
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, decide)):
        out = stage(spark, docs, sf)
        assert ids(out) == want(docs), name
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == corpus_pipeline.run(spark, sf).count() > 0


def test_sequences_hold_the_text_of_every_document_that_the_mix_took(spark, sf):
    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    encoder, _ = encoding(VOCABULARY)
    pieces, whole, bins = defaultdict(list), set(), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        ids = np.frombuffer(r.token_ids, id_type(VOCABULARY)).tolist()
        bins[r.bin_id].append((r.bin_offset, len(ids), r.capacity))
        pieces[r.doc_id, r.start].append(ids)
    for (i, _), copies in pieces.items():
        assert all(c == copies[0] for c in copies) and len(copies) <= 2
        whole.add(i)
    for i in whole:
        ids = [t for (j, _), c in sorted(pieces.items()) if j == i for t in c[0]] if i % 20 == 0 else None
        assert ids is None or encoder.decode(ids) == texts[i]
    for b in bins.values():
        at = 0
        for offset, n, capacity in sorted(b):
            assert offset == at
            at += n
        assert at <= b[0][2]


def test_stages_on_odd_rows(spark, make_docs, odd_rows, repeats, tmp_path):
    """Nulls, repeats, clashing columns and an empty table go through every stage."""
    spark.createDataFrame([(20, 1, 0), (21, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd_rows + repeats, []):
        docs = make_docs(rows)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            at = str(tmp_path / f"{len(rows)}-{name}")
            out.write.parquet(at)
            after = spark.read.parquet(at)
            assert k == 4 or after.columns == docs.columns, name
            assert after.count() > 0 if rows else after.count() == 0, name
            docs = after
