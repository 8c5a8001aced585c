import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest import shared
from palimpsest.config import Config, ConfigError, parse
from palimpsest.functions import checksums, text
from palimpsest.functions.kinds import BUILT_IN, normalise, normalise_of, specificity, tag, tag_of
from palimpsest.functions.phone import is_phone
from palimpsest.operators.detect import Scanner
from palimpsest.operators.vault import Vault, VaultError
from palimpsest.plans.clean import clean, clean_with_values, restore, spans, summary

FR = Config(regions=("FR",))


def found(value, kind, config=FR):
    return [s[6] for s in Scanner(config).spans(value) if s[3] == kind]


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [
        ("Ring 07 55 21 43 65 before 9", "phone", ["07 55 21 43 65"]),
        ("07 55 21 43 65\n7 avenue Victor Hugo", "phone", ["07 55 21 43 65"]),
        ("either 07 55 21 43 65 07 55 21 43 66", "phone", ["07 55 21 43 65", "07 55 21 43 66"]),
        ("Paid by 5555 5555 5555 4444 17 items", "credit_card", ["5555 5555 5555 4444"]),
        ("830 152 971\n830 152 971", "siren", ["830 152 971"] * 2),
        ("firm 830 152 971; again 830 152 971", "siren", ["830 152 971", "830 152 971"]),
        ("account DE89 3704 0044 0532 0130 00 closed", "iban", ["DE89 3704 0044 0532 0130 00"]),
        ("branch 83015297100032 open", "siret", ["83015297100032"]),
        ("order 83015297100033 open", "siret", []),
        ("from 10.20.30.40 to 10.20.30.400", "ip_address", ["10.20.30.40"]),
        ("fe80::aa:1 beside ::", "ip_address", ["fe80::aa:1"]),
        ("lots 1111111 or 2222222", "phone", []),
        ("eva@nordlicht.example, cc it.help@eu.nordlicht.example", "email", ["eva@nordlicht.example", "it.help@eu.nordlicht.example"]),
        ("They bought 2 more boxes.", "address", []),
        ("Sales of March 2031 were fine.", "address", []),
        ("Page 9 of the way there.", "address", []),
        ("Bring it to 7 avenue Victor Hugo\r\nsoon.", "address", ["7 avenue Victor Hugo"]),
    ],
)
def test_recognisers(value, kind, want):
    assert found(value, kind) == want


@pytest.mark.parametrize("want", ["8 Elm Street", "Lindenweg 9", "Molenstraat 8", "6 Calle Sol", "15 via Dante", "19 Kungsgatan", "EC1A 1BB", "M5V 2T6", "2511 BT Den Haag", "Austin, TX 73301", "69006 Lyon"])
def test_addresses_of_many_places(want):
    assert any(want in f for f in found(f"They moved to {want} last week.", "address"))


def test_phone_regions():
    assert found("+49 30 901820 or 07 55 21 43 65", "phone", Config()) == ["+49 30 901820"]
    assert len(found("Mobile 07700 900123, office 07 55 21 43 65.", "phone", Config(regions=("FR", "GB")))) == 2
    assert not is_phone("07700 900123", ("FR",)) and not is_phone("99", ("FR",))
    assert not is_phone("+49 0", ()) and not is_phone("+999 123456789", ())


def test_resolution_and_identity(spark):
    docs = spark.createDataFrame([(1, "SIREN 830152971 since 2031, SIRET 83015297100032, 5555 5555 5555 4444"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.tag, r.value) for r in spans(docs, FR).orderBy("start").collect()]
    assert got == [("SIREN", "830152971"), ("SIRET", "83015297100032"), ("CARD", "5555 5555 5555 4444")]


def test_taxonomy_columns_equal_functions(spark):
    rows = [(k, None, v) for k, _, _ in BUILT_IN for v in ("  Ab  C\td ", "+33 (0)1.2", "fr76 12-3")] + [("custom", c, " X  y ") for c in ("2fa code", "é", "a-b", "__")]
    df = spark.createDataFrame(rows, "kind string, custom string, v string")
    got = df.select("*", tag(F.col("kind"), F.col("custom")).alias("t"), normalise(F.col("kind"), F.col("v")).alias("n"), specificity(F.col("kind")).alias("s")).collect()
    for r in got:
        assert r.t == tag_of(r.kind, r.custom) and r.n == normalise_of(r.kind, r.v) and r.s
    assert tag_of("custom", "2fa code") == "2FA_CODE" and tag_of("custom", "é") == "CUSTOM"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=8, max_size=19), st.integers(0, 7), st.integers(1, 9))
def test_luhn_notices_any_single_wrong_digit(digits, at, shift):
    body = "".join(map(str, digits))
    valid = next(body + str(c) for c in range(10) if checksums.is_luhn(body + str(c)))
    wrong = valid[:at] + str((int(valid[at]) + shift) % 10) + valid[at + 1 :]
    assert not checksums.is_luhn(wrong)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_spans_lie_within_any_text(value):
    for s in Scanner(FR).spans(value):
        assert 0 <= s[0] < s[1] <= len(value) and value[s[0] : s[1]] == s[6]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=" \t\n ab", max_size=60))
def test_tidy_is_stable_and_keeps_what_is_visible(value):
    t = text.tidy_text(value)
    assert text.tidy_text(t) == t and re.sub(r"\s", "", t) == re.sub(r"\s", "", value) and t.count("\n") <= value.count("\n") + 1


def test_checksums_and_tidy_as_columns(spark):
    vs = ["5555555555554444", "5555555555554445", "", "1", "00", "NL91ABNA0417164300", "DE89 3704 0044 0532 0130 00", "NL91", "1.2.3.4", "01.2.3.4", "256.1.1.1", "a  \n\n\n\n b\t\n", "\n\nx", " \n ", "٣٤", "a\r\nb \r\n"]
    got = spark.createDataFrame([(v,) for v in vs], "v string").select("v", checksums.luhn(F.col("v")).alias("l"), checksums.iban(F.col("v")).alias("i"), checksums.ipv4(F.col("v")).alias("p"), text.tidy(F.col("v")).alias("t")).collect()
    for r in got:
        assert (r.l, r.i, r.p, r.t) == (checksums.is_luhn(r.v), checksums.is_iban(r.v), checksums.is_ip(r.v, 4), text.tidy_text(r.v)), r.v


def test_config_is_strict():
    c = parse('regions = ["FR"]\nallowlist = [" Rennes "]\n[[denylist]]\nterm = "Nordlicht"\n[[denylist]]\nterm = "Eva"\nkind = "client"\ncase_sensitive = true\n[[patterns]]\nname = "2fa code"\nregex = "CODE-\\\\d{4}"\n')
    assert c.allows("RENNES") and c.denylist[0].kind == "organisation" and c.denylist[1].kind == "person"
    assert [s[6] for s in Scanner(c).spans("nordlicht NORDLICHTS Eva eva CODE-1234") if s[3] != "phone"] == ["CODE-1234", "nordlicht", "Eva"]
    for bad in ("nope = 1", "ner_threshold = 2", 'regions = ["XX"]', '[[denylist]]\nterm = " "', '[[patterns]]\nname = "a"\nregex = "("', '[[patterns]]\nname = "a"\nregex = "(?=x)"', "[[patterns]]\nname = 'a'"):
        with pytest.raises(ConfigError):
            parse(bad)
    assert parse("", {"LANG": "fr_FR.UTF-8"}).regions == ("FR",) and parse("regions = []", {"LANG": "fr_FR"}).regions == ()


def test_allowlist_beats_denylist_and_every_layer():
    c = Config(allowlist=frozenset({"nordlicht"}), denylist=parse('[[denylist]]\nterm = "Nordlicht"').denylist)
    assert Scanner(c, lambda t: [(0, 9, "organisation", None, 0.9)]).spans("Nordlicht") == []


def test_clean_number_restore(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.example, 10.20.30.40; A@B.example"), (2, "c@d.example a@b.example [[PERSON_9]]"), (3, "nothing"), (4, None), (5, "[[EMAIL_99999999999999999999]] [[EMAIL_002]]")], "doc_id int, text string")
    store = Vault(spark, tmp_path / "v", tmp_path / "key")
    out = {r.doc_id: r for r in clean(docs, FR, store).collect()}
    assert out[1].text == "[[EMAIL_1]], [[IP_1]]; [[EMAIL_1]]" and out[1].replaced == 3 and out[1].by_tag == {"EMAIL": 2, "IP": 1}
    assert out[2].text == "[[EMAIL_2]] [[EMAIL_1]] [[PERSON_9]]" and out[3].text == "nothing" and out[4].text is None and out[3].by_tag == {}
    assert summary(clean(docs, FR, store)).first()[0] == "5 replaced: EMAIL 4, IP 1"
    back = {r.doc_id: r for r in restore(clean(docs, FR, store).drop("replaced", "by_tag"), store).collect()}
    assert back[1].text == "a@b.example, 10.20.30.40; a@b.example" and (back[2].restored, back[2].unknown) == (2, 1)
    assert back[5].text == "[[EMAIL_99999999999999999999]] c@d.example" and back[5].unknown == 1 and back[4].text is None
    assert [(r.tag, r.seq) for r in store.entries().collect()] == [("EMAIL", 1), ("EMAIL", 2), ("IP", 1)]
    store.check()
    more = spark.createDataFrame([(0, "z@z.example c@d.example")], "doc_id int, text string")
    assert clean(more, FR, Vault(spark, tmp_path / "v", tmp_path / "key")).first().text == "[[EMAIL_3]] [[EMAIL_2]]"
    with pytest.raises(Exception, match="(?i)decrypt|aes|tag"):
        Vault(spark, tmp_path / "v", tmp_path / "other").values().collect()
    assert store.purge() == 4 and clean(more, FR, store).first().text == "[[EMAIL_1]] [[EMAIL_2]]"
    (tmp_path / "bad").write_bytes(b"x")
    with pytest.raises(VaultError):
        Vault(spark, tmp_path / "v", tmp_path / "bad")
    assert (tmp_path / "key").stat().st_mode & 0o777 == 0o600


def on_disk(folder):
    """All bytes of the files below a folder."""
    return b"".join(f.read_bytes() for f in sorted(folder.rglob("*")) if f.is_file())


def test_no_value_is_written_in_the_clear(spark, tmp_path, monkeypatch):
    folder = tmp_path / "shared"
    monkeypatch.setitem(shared._RUNS, spark.sparkContext.applicationId, f"file://{folder}")
    docs = spark.createDataFrame([(i, f"planted.{i}@secret.example and 10.20.30.{i}") for i in range(50)], "doc_id int, text string")
    store = Vault(spark, tmp_path / "v", tmp_path / "k")
    out = clean(docs, FR, store)
    assert out.where("replaced = 2").count() == 50 and restore(out.select("doc_id", "text"), store).where("restored = 2").count() == 50
    plain, values = clean_with_values(docs, FR)
    assert plain.where("replaced = 2").count() == 50 and values.where("value like 'planted%'").count() == 50
    assert not list(folder.glob("spans-*"))
    # uncompressed copies of what Parquet holds, beside the bytes themselves
    cells = repr([r for d in folder.iterdir() for r in spark.read.parquet(str(d)).collect()]).encode()
    raw = on_disk(folder) + on_disk(tmp_path / "v") + cells
    assert len(raw) > 1000 and b"planted" not in raw and b"secret.example" not in raw and b"10.20.30." not in raw


def test_sealed_tables_come_back_and_go(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, v string")
    back = shared.save(df, "t", ("v",))
    assert {(r.id, r.v) for r in back.collect()} == {(1, "a"), (2, None), (3, "")} and back.schema == df.schema
    shared.drop(back)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        back.collect()


def test_restoring_ignores_ids_and_row_order(spark):
    from palimpsest.operators.rewrite import restore as put_back

    n, threshold = 20_000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    docs = spark.range(n).selectExpr("cast(id % 7 as int) as doc_id", "concat('at [[EMAIL_', id % 501, ']] end ', id) as text", "concat('at ', id % 501, '@x end ', id) as want").repartition(13)
    values = spark.range(500).selectExpr("'EMAIL' as tag", "id as seq", "concat(id, '@x') as value")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = put_back(docs, values)
        assert got.where("unknown = 0 and text <> want").isEmpty() and got.where("unknown = 1 and text <> concat('at [[EMAIL_500]] end ', substring_index(text, ' ', -1))").isEmpty()
        assert got.count() == n and got.where("unknown = 1").count() == n // 501 - (0 if n % 501 else 1) + (1 if n % 501 > 500 else 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_two_processes_share_one_vault(spark, tmp_path):
    """Each process waits for the other's lock; values that both allocate get one number."""
    import subprocess
    import sys

    work = (
        "import sys; from pyspark.sql import SparkSession; from palimpsest.config import Config; from palimpsest.operators.vault import Vault; from palimpsest.plans.clean import clean\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "v = Vault(s, sys.argv[1] + '/v', sys.argv[1] + '/k')\n"
        "for i in range(2):\n"
        "    d = s.createDataFrame([(0, f'both{i}@x.example own{i}.{sys.argv[2]}@x.example')], 'doc_id int, text string')\n"
        "    print('DONE', clean(d, Config(), v).first().text)\n"
    )
    Vault(spark, tmp_path / "v", tmp_path / "k")
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    each = [subprocess.Popen([sys.executable, "-c", work, str(tmp_path), str(k)], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, env=env) for k in range(2)]
    said = [p.communicate(timeout=240) for p in each]
    texts = [[line.split()[1:] for line in out.splitlines() if line.startswith("DONE")] for out, _ in said]
    assert all(len(t) == 2 for t in texts), said
    assert [t[0] for t in texts[0]] == [t[0] for t in texts[1]] and len({w for t in texts for pair in t for w in pair}) == 6
    store = Vault(spark, tmp_path / "v", tmp_path / "k")
    store.check()
    assert sorted(r.seq for r in store.entries().collect()) == [1, 2, 3, 4, 5, 6]


def test_round_trip_of_the_whole_table(spark, sf):
    from palimpsest.operators.rewrite import restore as put_back

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    cleaned, values = clean_with_values(docs, FR)
    assert cleaned.where("replaced > 0").count() > 0
    norm = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert norm(put_back(cleaned.select("doc_id", "text"), values)) == norm(docs)


def test_spread_looks_at_rows(spark, tmp_path):
    """The splits of a file of one row group: one of them has all rows."""
    from pyspark.sql import functions as F

    from palimpsest import shared

    def each(df):
        return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]

    spark.range(40_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = spark.read.parquet(str(tmp_path / "t")).select("id", F.upper("text").alias("text"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and max(each(df)) == 40_000
        got = each(shared.spread(df))
        assert len(got) >= spark.sparkContext.defaultParallelism and max(got) < 2 * 40_000 / len(got) and sum(got) == 40_000
        assert shared.spread(got := spark.range(0, 40, 1, 8)) is got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_spans_are_kept_without_their_values(spark):
    """Without a vault nothing needs the values again, sealed or not; with one, a value is opened once, not for each span."""
    from palimpsest.plans import clean as plans

    docs = spark.createDataFrame([(k, f"to a{k % 2}@b.example or A{k % 2}@b.example") for k in range(6)], "doc_id long, text string")
    found = plans._saved(plans.spans(docs, FR), "doc_id", False)
    assert not {"norm", "value", "kind"} & set(found.columns) and found.select("key").distinct().count() == 2 and found.count() == 12
    assert [tuple(r) for r in plans.numbered(found, "doc_id").select("tag", "seq").orderBy("seq").collect()] == [("EMAIL", 1), ("EMAIL", 2)]
    plan = plans._first_spellings(plans._saved(plans.spans(docs, FR), "doc_id", True).withColumn("ord", F.struct("doc_id", "nth")))
    assert sorted((r.norm, r.value) for r in plan.collect()) == [("a0@b.example", "a0@b.example"), ("a1@b.example", "a1@b.example")]


def test_settled_is_resolve(spark):
    """What the scan settles is what the column function does."""
    import random

    from pyspark.sql import types as T

    from palimpsest.operators.detect import SPANS, settled
    from palimpsest.operators.resolve import resolve

    r = random.Random(5)
    cases = []
    for k in range(300):
        starts = [r.randrange(40) for _ in range(r.choice([0, 1, 2, 3, 6, 20]))]
        ends = [a + r.randrange(9) for a in starts]
        cases.append((k, [(a, b, b - a, "email", None, r.choice([1, 5]), "t", r.choice([1.0, 0.5, 0.1, 0.1 + 1e-12]), n) for n, (a, b) in enumerate(zip(starts, ends, strict=True))]))
    t = spark.createDataFrame(cases, T.StructType([T.StructField("k", T.IntegerType()), T.StructField("s", SPANS)]))
    got = {x.k: [(y.start, y.end, y.ord) for y in x.s] for x in t.select("k", resolve(F.col("s")).alias("s")).collect()}
    assert got == {k: [(x[0], x[1], x[8]) for x in settled(s)] for k, s in cases}


def test_json_is_parsed_once_to_be_written(monkeypatch):
    from palimpsest.plans import tools

    parsed = []
    monkeypatch.setattr(tools.json, "loads", lambda p, loads=tools.json.loads: (parsed.append(p), loads(p))[1])
    assert tools._written('{"a": ["x", 1, "y"], "y": "z"}', [1, 2], ["Y", "Z"]) == '{"a": ["x", 1, "Y"], "y": "Z"}' and len(parsed) == 1
    assert tools._written("[1,2]", None, None) == "[1, 2]" and tools._written("no", None, None) is None and tools._written(None, None, None) is None


def test_restored_json_takes_marked_strings_alone(spark, tmp_path):
    """Strings without placeholders aren't read once more, and no value is opened before it has been looked up."""
    from palimpsest.plans.tools import clean_json, restore_json

    store = Vault(spark, tmp_path / "v", tmp_path / "k")
    given = ['{"to": ["a@b.example", "none", "c@d.example a@b.example"], "n": 1}', '["[[EMAIL_9]]", "x"]', '"plain"', "no JSON", None]
    rows_ = spark.createDataFrame(list(enumerate(given)), "id int, payload string")
    cleaned = clean_json(rows_, FR, store)
    assert cleaned.where("id = 0").first().payload == '{"to": ["[[EMAIL_1]]", "none", "[[EMAIL_2]] [[EMAIL_1]]"], "n": 1}'
    back = restore_json(cleaned, store)
    assert [r.payload for r in back.orderBy("id").collect()] == [*given[:3], None, None]
    assert "Union" not in back._jdf.queryExecution().toString()


def test_detection_hands_back_slices_without_texts(spark, monkeypatch):
    """A worker holds a batch and the spans of a slice of it; texts that nothing reads again stay where they are."""
    from palimpsest.operators import detect as d

    docs = spark.range(2_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("to a"), F.col("id").cast("string"), F.lit("@b.example")).alias("text")).coalesce(1)
    sent = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: sent.update(run=run, names=schema.fieldNames()) or df)
    d.detect(docs, FR, keep=("doc_id",))
    import pyarrow as pa

    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(2_500)), "text": [f"to a{k}@b.example" for k in range(2_500)]})
    out = list(sent["run"](iter([whole])))
    assert sent["names"] == ["doc_id", "spans"] == out[0].schema.names and [b.num_rows for b in out] == [1_000, 1_000, 500]
    assert [(i, s[0]["text"]) for b in out for i, s in zip(*b.to_pydict().values(), strict=True)] == [(k, f"a{k}@b.example") for k in range(2_500)]
