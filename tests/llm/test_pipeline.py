"""The pipeline against plain Python, stage by stage."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from firstpast.llm import blob_ledger, bradley_terry, compression_bands
from test_blob_ledger import brute as secrets_of
from test_ga_packing import check_pieces, check_places, ids_of
from test_pivot_simhash import slow_components, slow_print


def redacted(text):
    """Merge overlapping base spans and mark them."""
    out, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in secrets_of(text)):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_run_by_brute_force(spark, sf_dir, documents, labels, plain):
    model = bradley_terry.fit(documents, labels)
    score, judge = bradley_terry._score(model), compression_bands.judge()
    kept = [(i, t) for i, t in plain if score(t) >= bradley_terry.ACCEPTED and judge(t).kept]
    lowest = slow_components([(i, slow_print(t)) for i, t in kept])
    kept = [(i, redacted(t)) for i, t in kept if lowest[i, slow_print(t)] == i]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(by_doc) == {i for i, _ in kept}
    for i, text in kept:
        check_pieces(by_doc[i], ids_of(library, text))
    assert check_places(rows) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_stages_return_the_columns_of_documents(spark, sf_dir, tricky, nothing):
    for docs in (tricky, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_registered(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(re.match(f"op{n}_", x) for x in names) for n in range(1, 14))
    assert {"op4_blob_ledger", "op9_schema_chat", "op11_line_first"} <= set(__spark_entry__.oracle_sql())


def test_clean_documents_keep_their_text(spark, sf_dir, documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    after = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, documents, sf_dir).collect()}
    assert set(before) == set(after)
    for i, text in before.items():
        assert after[i] == redacted(text)
    assert blob_ledger.MORE
