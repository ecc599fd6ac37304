import pytest
from pyspark.sql import functions as F

from partslake.operators import enrich as H
from tests.conftest import tuples

def now():
    return F.timestamp_seconds(F.lit(1_700_000_000))


DAY = 86400


@pytest.fixture
def cache(rows):
    ages = [("a1", "Active", 1), ("a29", "Active", 29), ("a31", "Active", 31), ("ob", "Obsolete", 365), ("nr", "NRND", 365)]
    return rows([(m, "{}", life, 1_700_000_000 - d * DAY) for m, life, d in ages], "mpn string, payload_json string, lifecycle string, cached_at long")


def test_expiry(rows, cache):
    parts = rows([(m,) for m in ("a1", "a29", "a31", "ob", "nr", "none")], "part string")
    hits = tuples(H.cache_lookup(parts, cache, now()).filter("hit"), "part")
    assert hits == [("a1",), ("a29",), ("nr",), ("ob",)] == tuples(H.expire_stale(cache, now()), "mpn")


@pytest.mark.parametrize(
    "part, known", [("LM358N", "lm358"), ("lm358n", "lm358"), ("TL084IN", "tl081"), ("TL08A", None), ("PIC16F628A", "40044G"), ("XYZ123", None), ("", None)]
)
def test_prefixes(rows, part, known):
    url = rows([(part,)], "p string").select(H.family_datasheet(F.col("p")).alias("u")).first()["u"]
    assert known in url if known else url is None


def test_longest_prefix_wins(rows):
    rules = (("LM", "short"), ("LM358", "long"))
    assert rows([("LM358",)], "p string").select(H.family_datasheet(F.col("p"), rules)).first()[0] == "long"


def payload(sheet="https://d", life="Active"):
    return f'{{"category_path":"Op-amps/Dual","datasheet":"{sheet}","package":"DIP-8","lifecycle":"{life}"}}'


def test_chain_and_reasons(rows):
    parts = rows([(p,) for p in ("hit", "resp", "LM358X", "LM358Y", "gone", "bare", "down")], "part string")
    cache = rows([("hit", payload(life="NRND"), "NRND", 0)], "mpn string, payload_json string, lifecycle string, cached_at long")
    responses = rows(
        [("resp", "ok", payload()), ("LM358X", "ok", payload("")), ("LM358Y", "unknown", None), ("gone", "unknown", None), ("bare", "ok", payload("")), ("down", "unreachable", None)],
        "mpn string, status string, payload_json string",
    )
    got = {r["part"]: (r["origin"], r["reason"]) for r in H.enrich(parts, cache, responses, now()).collect()}
    assert got == {
        "hit": ("cache", None), "resp": ("response", None), "LM358X": ("response", None), "LM358Y": ("prefix", None),
        "gone": (None, "unknown_mpn"), "bare": (None, "fallback_missed"), "down": (None, "network_unreachable"),
    }
    offline = {r["part"]: r["reason"] for r in H.enrich(parts, cache, responses, now(), online=False).collect()}
    assert offline.pop("hit") is None and set(offline.values()) == {"offline"}
    cells = {r["part"]: (r["description"], r["notes"]) for r in H.enrichment_cells(H.enrich(parts, cache, responses, now())).collect()}
    assert cells == {"hit": ("Op-amps", "DIP-8; NRND"), "resp": ("Op-amps", "DIP-8"), "LM358X": ("Op-amps", "DIP-8"), "LM358Y": (None, None)}


def test_cache_put_round_trip(rows):
    cache = rows([("A", "{}", "Active", 5), ("B", "{}", "Obsolete", 5)], "mpn string, payload_json string, lifecycle string, cached_at long")
    payload = '{"lifecycle": "NRND",  "datasheet":"d"}'
    answers = rows([("A", "ok", payload), ("C", "ok", payload), ("B", "unknown", None), ("D", "unreachable", payload), (None, "ok", payload)],
                   "mpn string, status string, payload_json string")
    put = H.cache_put(cache, answers, F.timestamp_seconds(F.lit(99)))
    assert tuples(put) == [("A", payload, "NRND", 99), ("B", "{}", "Obsolete", 5), ("C", payload, "NRND", 99)]
    got = H.cache_lookup(rows([("C",)], "part string"), put, F.timestamp_seconds(F.lit(9_999_999))).first()
    assert got["hit"] and got["payload_json"] == payload
