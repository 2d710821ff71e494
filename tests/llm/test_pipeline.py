"""The pipeline against its stages' meaning, one after the other."""

import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata import steps
from lodestrata.llm import toxicity
from lodestrata.llm.common import documents, labels

from .test_groups import brute_components

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = documents(spark, DATA)
    columns, state = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, DATA)
        assert state.columns == columns
        kept[name] = {r.doc_id: r for r in state.collect()}
        state = spark.createDataFrame(list(kept[name].values()), docs.schema)
    everything = {r.doc_id: r for r in docs.collect()}
    machine = toxicity.fit(docs, labels(spark, DATA), F.lit(True))
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, machine).collect()}
    assert set(kept["toxicity"]) == {d for d, p in scores.items() if not p}
    rows = [(d, everything[d].text) for d in kept["toxicity"]]
    assert set(kept["near_copies"]) == {d for d, (_, root) in brute_components(rows, 5, 80).items() if root == d}
    assert set(kept["repeated_passages"]) == set(kept["near_copies"]) == set(kept["personal_data"])
    first = min(kept["near_copies"])
    assert len(kept["repeated_passages"][first].text) <= len(everything[first].text)
    seen = set()
    for d in sorted(kept["repeated_passages"]):
        text = everything[d].text
        fresh = all(text.encode()[k : k + 100] not in seen for k in range(max(0, len(text.encode()) - 99)))
        inner = [text.encode()[k : k + 100] for k in range(max(0, len(text.encode()) - 99))]
        if fresh and len(set(inner)) == len(inner):
            assert kept["repeated_passages"][d].text == text
        seen.update(inner)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d, r in kept["personal_data"].items():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        want |= {(d, k, at, len(ids[at : at + 4096]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + 4096]))) for k, at in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names, no rows; each stage alone and run()."""
    names = ["base", "proposals", "spans", "row", "id", "now", "kept", "component_id", "__gone"]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    more = tuple(names)
    long = " ".join("".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(60_000))
    rows = [(1, None, None, *more), (2, "", "en", *more), (None, "no id", None, *[None] * len(names)), (None, None, None, *more), (3, long, "en", *more), (4, "same words", "en", *more),
            (4, "same words", "en", *more), (4, "other words here", "de", *more), (5, long + " tail", "en", *more), (6, "write to a@b.org", None, *more)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        found = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
        if name == "near_copies":
            want = [(1, None), (2, ""), (None, "no id"), (None, None), (3, long), (4, "other words here"), (6, "write to a@b.org")]
        elif name == "personal_data":
            want = [(r[0], r[1].replace("a@b.org", "[EMAIL]") if r[1] else r[1]) for r in rows]
        elif name == "repeated_passages":
            want = [(r[0], " tail" if r[0] == 5 else r[1]) for r in rows]
            assert [d for d, _ in found] == [d for d, _ in sorted(want, key=repr)]
            continue
        else:
            want = [(r[0], r[1]) for r in rows]
        assert found == sorted(want, key=repr), name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    pieces = corpus_pipeline.pack(spark, docs, DATA).collect()
    assert sum(r.piece == 0 for r in pieces) == len(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, DATA).write.parquet(str(tmp_path / "labels.parquet"))
    before = set(steps.existing())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id or 0 for r in out.collect()}) == [0, 1, 2, 3, 4, 6]
    assert set(steps.existing()) - before == {out._step}


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "personal_data", "packing"]
