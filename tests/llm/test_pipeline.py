import tidewire.llm.queries as q
from corpus_pipeline import ORACLE_SQL, STAGES, run
from tests.llm.test_near_duplicates import components, plain_fingerprint
from tests.llm.test_pii import plain_spans
from tidewire.llm.pii import redact
from tidewire.llm.simhash import keep_one_per_class


def test_one_query_of_each_number():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(q.QUERIES) <= set(names) and ORACLE_SQL is None and len(STAGES) == 5


def test_stages_run_on_the_small_table(spark, sf):
    rows = run(spark, sf).collect()
    kept = {r.doc_id for r in rows}
    all_ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert kept and kept < all_ids


def test_one_document_of_each_group_stays(spark, docs, no_docs, sf):
    for frame in (spark.read.parquet(f"{sf}/documents.parquet"), docs):
        rows = frame.collect()
        prints = {plain_fingerprint(r.text) for r in rows}
        root = components(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 4)
        got = keep_one_per_class(frame).collect()
        assert keep_one_per_class(frame).columns == frame.columns
        assert sorted(root[plain_fingerprint(r.text)] for r in got) == sorted(set(root.values()))
        least = {}
        for r in rows:
            if r.doc_id is not None:
                c = root[plain_fingerprint(r.text)]
                least[c] = min(least.get(c, r.doc_id), r.doc_id)
        assert all(r.doc_id == least.get(root[plain_fingerprint(r.text)]) for r in got)
    assert keep_one_per_class(no_docs).count() == 0


def test_texts_are_not_written_again_to_drop_near_duplicates(docs, monkeypatch):
    from tidewire.llm import simhash

    columns, written = [], simhash.cut_lineage

    def seen(df):
        columns.extend(df.columns)
        return written(df)

    monkeypatch.setattr(simhash, "cut_lineage", seen)
    assert keep_one_per_class(docs).count() > 0
    assert "_fp" in columns and not {"text", "_doc"} & set(columns)


def test_redaction(spark, docs, no_docs):
    texts = [(1, "mail a.b@c.de now 10.0.0.1 end"), (2, "+1 (743) 555-3824"), (3, "no data"), (4, None), (5, ""), (6, "é a@b.co"), (6, "é a@b.co")]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted([(r.doc_id, r.text, r.n_chars) for r in redact(frame).collect()], key=str)
    want = [(1, "mail [EMAIL] now [IP] end", 25), (2, "[PHONE]", 7), (3, "no data", 0), (4, None, 0), (5, "", 0), (6, "é [EMAIL]", 9), (6, "é [EMAIL]", 9)]
    assert got == want
    assert redact(frame).columns == frame.columns and redact(no_docs).count() == 0
    assert sum(bool(plain_spans(r.text)) for r in redact(docs).collect()) == 0
