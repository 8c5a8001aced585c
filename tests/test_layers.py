import hashlib

import pytest

from palimpsest.config import Config
from palimpsest.functions.sql import register
from palimpsest.operators.layers import locate, names, select_languages, verify
from palimpsest.plans.clean import spans
from palimpsest.sources.formats import ConversionError


def test_model_layer(spark):
    def load():
        def predict(text, labels):
            assert labels[0] == "person"
            return [("person", "Zoë Dupont", 0, 11, 0.9), ("company", "Acme", 90, 94, 0.2), ("person", "Low", 0, 3, 0.1), ("animal", "cat", 0, 3, 0.9)]

        return predict

    df = spark.createDataFrame([(1, "Zoë Dupont met Acme; Acme paid."), (2, " ")], "doc_id int, text string")
    got = [(r.tag, r.value, r.start) for r in spans(df, Config(), layer=names(Config(), load)).orderBy("start").collect()]
    assert got == [("PERSON", "Zoë Dupont", 0), ("ORG", "Acme", 15), ("ORG", "Acme", 21)]
    assert names(Config(ner_enabled=False), load) is None and names(Config(), None) is None


def test_offsets_are_repaired():
    assert list(locate("éa éa", "éa", 0, 3)) == [(0, 2)] and list(locate("éa éa", "éa", 3, 5)) == [(3, 5)]
    assert list(locate("éa éa", "éa", 1, 2)) == [(0, 2), (3, 5)] and list(locate("x", "", 0, 0)) == []


def test_languages(tmp_path):
    assert select_languages(("fra", "eng"), None) == "fra+eng" and select_languages((), ["fra", "eng", "deu"]) == "eng+deu+fra"
    assert select_languages((), None) == "eng" and select_languages((), ["a", "b", "c", "d", "eng"]) == "eng" and select_languages((), list("abcde")) == "a"
    with pytest.raises(ConversionError):
        select_languages(("fra",), ["eng"])
    (tmp_path / "m").write_bytes(b"abc")
    assert verify(str(tmp_path / "m"), hashlib.sha256(b"abc").hexdigest(), 3) and not verify(str(tmp_path / "m"), "0", 3)


def test_sql_functions(spark):
    assert "detect_spans" in register(spark, Config(regions=("FR",)))
    r = spark.sql("SELECT is_luhn('4242424242424242') AS a, is_iban('FR14') AS b, is_phone('06 12 34 56 78') AS c, normalise('phone', '+33 1') AS d, tidy('a  ') AS e, is_ipv6('::1') AS f").first()
    assert tuple(r) == (True, False, True, "+331", "a\n", True)
    rows = spark.sql("SELECT d.id, s.kind, s.text FROM VALUES (1, 'a@b.example'), (2, 'none') AS d(id, t), LATERAL detect_spans(d.t) s").collect()
    assert [tuple(r) for r in rows] == [(1, "email", "a@b.example")]
