import pytest
from helpers import value
from pyspark.sql import functions as F

from spanloom.functions import ids, privacy, spans, times, values


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    return h


def test_fnv_and_hashed_ids(spark):
    for text in ("", "a", "|long.hierarchical.id_", "ünïcode"):
        assert value(spark, ids.fnv1a64(F.lit(text))) == f"{fnv(text.encode()):016x}"
    raw = "not hex at all"
    want = "".join(f"{fnv(raw.encode() + seed.to_bytes(8, 'little')):016x}" for seed in range(2))
    assert value(spark, ids.trace_id(F.lit(raw))) == want
    assert value(spark, ids.span_id(F.lit(raw))) == want[:16]


@pytest.mark.parametrize("raw,length,want", [
    ("1-5759e988-bd862e3fe1be46a994272793", 32, "5759e988bd862e3fe1be46a994272793"),
    (" ABC ", 16, "0000000000000abc"), ("463ac35c9f6413ad", 32, "0" * 16 + "463ac35c9f6413ad")])
def test_ids(spark, raw, length, want):
    assert value(spark, ids.normalize_id(F.lit(raw), length)) == want


def test_otlp_ids_and_base64(spark):
    assert value(spark, ids.otlp_id(F.lit("AAAAAAAAAAI="), 16)) == "0000000000000002"
    assert value(spark, ids.otlp_id(F.lit("AAAAAAAAAAA="), 16)) is None
    assert value(spark, ids.otlp_id(F.lit("0" * 16), 16)) == "0" * 16
    assert value(spark, ids.otlp_id(F.lit(""), 16)) is None
    assert bytes(value(spark, ids.base64_bytes(F.lit("-_8")))) == b"\xfb\xff"
    assert value(spark, ids.base64_bytes(F.lit("a b"))) is None
    assert value(spark, ids.decimal_id(F.lit("18446744073709551615"))) == "f" * 16
    assert value(spark, ids.decimal_id(F.lit("123"))) == "000000000000007b"


@pytest.mark.parametrize("text,want", [
    ("1970-01-01T00:00:01Z", 1_000_000_000), ("2026-09-28T10:00:00.5+02:00", 1_790_582_400_500_000_000),
    ("2026-09-28 08:00:00.123456789", 1_790_582_400_123_456_789), ("2026-09-28T08:00Z", 1_790_582_400_000_000_000),
    ("garbage", None), ("1969-12-31T23:59:59Z", None), ("2026-13-01T00:00:00Z", None)])
def test_rfc3339(spark, text, want):
    assert value(spark, times.rfc3339_ns(F.lit(text))) == want


def test_durations_and_iso(spark):
    assert [times.duration_ms(t) for t in ("30s", "10m", "2h", "1d")] == [30_000, 600_000, 7_200_000, 86_400_000]
    for bad in ("10", "m", "5w", ""):
        with pytest.raises(ValueError):
            times.duration_ms(bad)
    assert value(spark, times.iso(F.lit(1_790_582_953_928))) == "2026-09-28T08:09:13Z"
    assert [times.human_ns(n) for n in (400_000, 37_000_000, 1_250_000_000)] == ["0.4 ms", "37 ms", "1.25 s"]


def test_globs(spark):
    cases = [("stock*", "stock-api", True), ("*orders*", "POST /orders/42", True), ("a?c", "abc", True), ("stock*", "orders", False),
             ("*", "", True), ("a.c", "abc", False), ("*a*b?", "xxaybz", True), ("?", "é", True), ("a*", "a\nb", True)]
    for pattern, text, want in cases:
        assert value(spark, values.glob(pattern, F.lit(text))) is want, (pattern, text)


def test_expectations(spark):
    cases = [(3, '"3"', True), ("3", "3", True), (3.0, "3", False), ("*", "false", True), ("*", None, False), ("*", "null", False),
             ("!", None, True), ("!", '"4111"', False), (r"re:^o-\d+$", '"o-42"', True), (r"re:^o-\d+$", '"o-42\\n"', False),
             ("re:2", "123", True), ({"a": 1}, '{"a":1}', True), ('a"b', '"a\\"b"', True)]
    for expected, actual, want in cases:
        got = value(spark, values.value_matches(expected, F.lit(actual).cast("string")))
        assert got is want, (expected, actual)


def test_peers(spark):
    def peer(**attrs):
        m = F.create_map(*[F.lit(x) for k, v in attrs.items() for x in (k.replace("__", "."), values.json_text(v))])
        df = spark.range(1).select(m.alias("attributes"), F.create_map(F.lit("server.address"), F.lit('"fallback"')).alias("resource"))
        return df.select(spans.peer().alias("p")).first()["p"]

    assert peer(peer__service="stock") == "stock"
    assert peer(peer__service="", db__system="postgresql", db__name="shop") == "postgresql:shop"
    assert peer(db__name="shop") == "fallback"
    assert peer(messaging__system="kafka", messaging__destination="q") == "q"
    assert peer(rpc__service=7) == "7"
    host = [value(spark, spans.host_of(F.lit(u))) for u in ("https://u:p@h.example:8443/x?y", "no-scheme", "http:///x")]
    assert host == ["h.example:8443", None, None]
    assert [value(spark, spans.path_of(F.lit(u))) for u in ("https://h/a/b?x#y", "https://h", "/p?q")] == ["/a/b", "/", "/p"]


def test_code_references(spark):
    def code(text):
        row = value(spark, spans.parse_code(F.lit(text)))
        return None if row is None else tuple(row)

    assert code("src/Repo.cs:List") == ("src/Repo.cs", None, "List")
    assert code("app/orders.py:42") == ("app/orders.py", 42, None)
    assert code("handler.go:12:Handle") == ("handler.go", 12, "Handle")
    assert code("C:\\src\\Program.cs:Main") == ("C:\\src\\Program.cs", None, "Main")
    assert code("tools/Program.cs (root span)") == ("tools/Program.cs", None, None)
    assert code("an SDK (Some.Thing)") is None
    assert code("") is None


def test_kinds(spark):
    got = [value(spark, spans.kind_from_name(F.lit(k))) for k in ("SPAN_KIND_CLIENT", "rpc_server", "", "weird", "Producer")]
    assert got == ["client", "server", "internal", "internal", "producer"]


def test_checksums(spark):
    for text, want in (("4111 1111 1111 1111", True), ("4111 1111 1111 1112", False), ("1234", False)):
        assert value(spark, privacy.luhn(F.lit(text))) is want
        assert privacy._luhn_text(text) is want
    for text, want in (("GB82 WEST 1234 5698 7654 32", True), ("DE89370400440532013001", False)):
        assert value(spark, privacy.iban_valid(F.lit(text))) is want
        assert privacy._iban_text(text) is want
    for text, want in (("+49 30 1234567", True), ("2026-09-25 1234", False), ("12345678901", False), ("0049301234567", True)):
        assert value(spark, privacy.phone_plausible(F.lit(text))) is want
        assert privacy._phone_text(text) is want
    assert value(spark, privacy.name_tokens(F.lit("userName.HTTPCode_2x"))) == ["user", "name", "httpcode", "2x"]
    assert value(spark, privacy.sanitize(F.lit("..Customer E-Mail!"))) == "customer_e_mail"
