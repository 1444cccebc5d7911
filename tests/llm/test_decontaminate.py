import hashlib
import re
from collections import Counter

from tracewarden.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, window=10):
    grams = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        if name is not None and n:
            for i in range(len(w) - n + 1):
                grams.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for gram, of in grams.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit.update(range(i, i + len(gram)))
                    names |= of
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    return out


def items_of(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = words(texts[0])
    items = [
        (1, " ".join(first[5:40])), (2, " ".join(first[30:60]).upper()), (10, "A-b"), (3, None), (4, "..."),
        (None, texts[3]), (5, " ".join(words(texts[6])[:10])), (5, " ".join(words(texts[9])[-12:])),
    ]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_edges(spark, edge_documents):
    items, benchmark = items_of(spark, edge_documents)
    expected = brute([(r.doc_id, r.text) for r in edge_documents.collect()], items)
    assert sum(r[-1] for r in expected) > 5
    for limit in (1 << 20, 150):  # one broadcast, and several passes
        got = decontaminate.contamination(edge_documents, benchmark, limit=limit).collect()
        assert Counter(map(tuple, got)) == Counter(expected)


def test_only_clean_documents_stay(spark, edge_documents):
    items, benchmark = items_of(spark, edge_documents)
    rows = [(r.doc_id, r.text) for r in edge_documents.collect()]
    clean = [r for r, x in zip(rows, brute(rows, items), strict=True) if not x[-1]]
    out = decontaminate.clean_documents(edge_documents, benchmark)
    assert out.columns == edge_documents.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(clean)


def test_empty(spark, edge_documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_documents, none).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(edge_documents, none).collect())
