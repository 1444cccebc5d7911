from tracewarden.operators import findings as C
from tracewarden.plans.derived import PLANTED


def test_each_planted_credential_is_found(texts):
    rows = C.scan_credentials(texts(list(PLANTED)), keys=["id"]).collect()
    found = {r.rule for r in rows}
    assert found == {c.id for c in C.CREDENTIALS}
    for r in rows:
        assert PLANTED[r.id][r.offset : r.offset + r.length] == r.match


def test_placeholders_are_suppressed(texts):
    kept = ["AI" + "za" + "a" * 35, "hf" + "_" + "X" * 34, "s." + "abcdefghijklmnopqrstuvwx", "xo" + "xb-xxxx-xxxx"]
    assert C.scan_credentials(texts(kept), keys=["id"]).count() == 0


def test_all_occurrences_and_inventory(texts):
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    hits = C.scan_credentials(texts([f"{key} {key}", key]), keys=["id"])
    row = C.secret_inventory(hits, "id").head()
    assert (row.rule, row.findings, row.rows) == ("credential_aws_key", 3, 2)
