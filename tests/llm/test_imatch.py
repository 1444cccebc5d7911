import hashlib
from collections import Counter

from tracewarden.llm import imatch


def expected_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = Counter()
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        out[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    return out


def test_order_and_edits(edge_documents):
    # Ties follow a hash of the text: only rows whose neighbours are certain are compared.
    rows = [(r.doc_id, r.text or "") for r in edge_documents.dropDuplicates(["doc_id"]).collect()]
    docs = edge_documents.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 2, 7):
        got = imatch.fingerprints(docs, low=0.0, parts=parts).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected_edits(rows)


def test_edges(edge_documents):
    got = imatch.fingerprints(edge_documents, low=0.0).collect()
    rows = edge_documents.collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r.doc_id, len(r.text or "")) for r in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    prints = {}
    for r in got:
        for text in texts[r.doc_id] if len(texts[r.doc_id]) == 1 else ():
            prints.setdefault(text, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_likeness_follows_the_share_of_terms():
    words = [f"w{i}" for i in range(400)]
    printer = imatch.Printer([imatch.xxhash.xxh3_64_intdigest(w.encode()) for w in words], 64)
    whole = printer.print_of(" ".join(words[:200]))
    near = printer.print_of(" ".join(words[:190]))
    half = printer.print_of(" ".join(words[100:300]))
    other = printer.print_of(" ".join(words[200:]))
    assert imatch.likeness(whole, whole) == 1
    assert imatch.likeness(whole, near) > 0.8 > imatch.likeness(whole, half) > imatch.likeness(whole, other)
    assert imatch.likeness(whole, printer.print_of("none of these")) == 0


def test_band_counts_all_documents(spark):
    rows = [(i, "often " + ("seldom " if i < 5 else "") + f"once{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = imatch.lexicon(docs, 0.02, 0.5)
    assert found == [imatch.xxhash.xxh3_64_intdigest(b"seldom")]


def test_single_and_empty(spark, no_documents):
    assert imatch.fingerprints(no_documents).collect() == []
    row = imatch.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
