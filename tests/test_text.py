from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import masking, text, vectors
from claimloom.functions.signals import SignalRules, signals
from claimloom.plans import registry
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def value(spark):
    def of(make, *args):
        row = spark.createDataFrame([args], ", ".join(f"a{k} {'string' if isinstance(a, str) or a is None else 'int' if isinstance(a, int) else 'array<string>'}" for k, a in enumerate(args)))
        return row.select(make(*[F.col(f"a{k}") for k in range(len(args))]).alias("x")).first()["x"]

    return of


def test_folding(value):
    assert value(text.fold_ascii, "İSTANBUL Çağrı IŞIK") == "istanbul cagri isik"
    assert value(text.lower_tr, "YARALI İzmir") == "yaralı izmir"
    assert value(text.fold_tr, "YARALI İZMİR") == "yarali izmir"


def test_sentences(value):
    assert value(text.sentences, "Sn. Ahmet geldi. Hasar 3.5 bin TL. Tamam mı? Evet!") == ["Sn. Ahmet geldi.", "Hasar 3.5 bin TL. Tamam mı?", "Evet!"]
    assert value(text.sentences, "") == []
    assert value(text.sentences, None) is None


def test_plain_sentences(spark, tmp_path):
    said = ["La casa. No. En una?", " a.\u00a0b\u00a0.\tc! \n", "\nx\u2003", "", " \n", "a.\x0bb. c", None, "No. 5 km. vs. dr."]
    spark.createDataFrame([(k, 0, t) for k, t in enumerate(said)], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.QUERIES["split_sentences"](spark, str(tmp_path)).toPandas()
    assert found.loc[found["conv_id"] == 0, ["sentences", "first"]].values.tolist() == [[3, "La casa."]]
    assert_same(found, connect(str(tmp_path)).sql(registry.ORACLES["split_sentences"]).df())


def test_snippets_of_plain_sentences(spark, tmp_path):
    spark.createDataFrame([(1, "the and of. No. with from this")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = registry.QUERIES["letters_search"](spark, str(tmp_path)).toPandas()
    assert_same(found, connect(str(tmp_path)).sql(registry.ORACLES["letters_search"]).df())


def test_normalisers(value):
    assert value(text.normalize_text, "  İzmir'de ") == "izmir"
    assert value(text.normalize_text, "   ") is None
    assert value(text.normalize_plate, "45 ABC 123") == "45abc123"
    assert value(text.normalize_amount, "12.500,75 TL").number == 12500.75
    assert value(text.normalize_amount, "1.250").number == 1250.0
    assert value(text.normalize_amount, "çok").text == "çok"


@pytest.mark.parametrize(("token", "grouped", "floating"), [("12.500", 12500, 12500), ("12,5", 12.5, 12.5), ("12500.00", 12500, 12500), ("1.234.567", 1234567, 1234567), ("1,234", 1.234, 1.234), ("3.5", 3.5, 3.5)])
def test_numbers(value, token, grouped, floating):
    assert float(value(text.number_as_grouped, token)) == grouped
    assert value(text.number_as_float, token) == floating


@pytest.mark.parametrize(("written", "day"), [("2026-07-15", "2026-07-15"), ("2026-02-31", None), ("2026-13-01", None), ("15/07/2026", None), ("2026", None), ("20260701", None), ("", None)])
def test_dates(value, written, day):
    found = value(text.iso_date, written)
    assert (found and found.isoformat()) == day


@pytest.mark.parametrize(("written", "flag"), [("true", True), ("True", True), ("FALSE", False), ("evet", None), ("belki", None), (None, None)])
def test_three_valued(value, written, flag):
    assert value(text.three_valued, written) is flag


def test_unverified_numbers(value):
    assert value(text.unverified_numbers, "Toplam 12.500 TL, 3 kayıt, 1.247 yok", "1. tutar: 12500.00", 3) == ["1.247"]


def test_citations(value):
    assert value(lambda a: text.renumber_citations(a, F.array(F.lit(3), F.lit(1))), "Bir [1] iki [3] üç [7] .") == "Bir [2] iki [1] üç."
    assert value(lambda a: text.split_citations(F.array(*map(F.lit, (3, 1, 3, 9))), F.array(F.lit(1), F.lit(3))), "x").asDict() == {"valid": [3, 1], "invalid": [9]}


def test_quotes(value):
    span = lambda q, t: (s := value(text.locate_quote, q, t)) and tuple(s)
    assert span("araç yandı", "Dün araç yandı.") == (4, 14)
    assert span("araç  yandı", "Dün araç\nyandı.") == (4, 14)
    assert span("ameliyat olmam", "Ameliyat olmam gerekti") == (0, 14)
    assert span("yok", "Dün") is None


def test_pattern_masking(value):
    m = value(masking.pattern_mappings, "TC 12345678901, plaka 06ABC34, tel 0532 111 22 33, yine 06ABC34")
    assert [(x.placeholder, x.real_value) for x in m] == [("[TC_1]", "12345678901"), ("[PHONE_1]", "0532 111 22 33"), ("[PLATE_1]", "06ABC34")]
    q = value(masking.mask_question, "34XY123 ne oldu?")
    assert q.text == "[Q_PLATE_1] ne oldu?"
    assert value(masking.has_question_placeholder, q.text)


CASES = [
    ("Ben Ahmet, TC 12345678901, aracim 06ABC34 hasar gordu", {"TC", "PLATE", "NAME"}),
    ("Numaram 0532 111 22 33, plaka 34XY123", {"PHONE", "PLATE"}),
    ("Mehmet aradi, IBAN TR330006100519786457841326", {"NAME", "IBAN"}),
    ("Ali ve Veli 06 A 1234 aracindaydi", {"NAME", "PLATE"}),
    ("Hasar 3500 TL, numaram 0555 987 65 43", {"PHONE"}),
]


def test_mask_all(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "id int, text string")
    names = spark.createDataFrame([(n,) for n in masking.STARTER_NAMES], "name string")
    found = {r["id"]: r for r in masking.mask_all(df, "id", "text", names).withColumn("back", masking.unmask(F.col("masked_text"), F.col("mappings"))).collect()}
    for k, (source, kinds) in enumerate(CASES):
        assert {m.pii_type for m in found[k].mappings} == kinds
        assert not any(m.real_value in found[k].masked_text for m in found[k].mappings)
        assert found[k].back == source


def test_ambiguous_names(spark):
    rows = [(1, "bugun deniz dalgali"), (2, "Deniz Yılmaz aradı"), (3, "Sayın Deniz geldi"), (4, "Ali Ali"), (5, ""), (6, None)]
    names = spark.createDataFrame([("deniz",), ("ali",)], "name string")
    out = {r[0]: r[1] for r in masking.mask_names(spark.createDataFrame(rows, "id int, text string"), "id", "text", names).select("id", "masked_text").collect()}
    assert out == {1: "bugun deniz dalgali", 2: "[NAME_1] Yılmaz aradı", 3: "Sayın [NAME_1] geldi", 4: "[NAME_1] [NAME_2]", 5: "", 6: None}


@pytest.mark.parametrize(
    ("message", "terms"),
    [
        ("Kazada yaralandı.", ["yaralandı"]), ("Kimse yaralanmadı, yaralanma yok", []), ("Yaralanma: hayır", []), ("Yaralanma:\nPlaka: 34", []),
        ("Yaralanan var mı?", []), ("bölüm mekanı", []), ("hastane otoparkında", []), ("hastaneye kaldırıldı", ["hastane"]), ("ambulans geldi", ["ambulans"]),
        ("kolumda kirik var", ["kırık"]), ("oluştu", []), ("", []), (None, []),
    ],
)
def test_signals(message, terms):
    assert SignalRules().find(message) == terms


def test_signal_column(spark):
    rows = spark.createDataFrame([("Kazada yaralandı.",), ("iyi",), (None,)], "t string")
    assert [r[0] for r in rows.select(signals(F.col("t"))).collect()] == [["yaralandı"], [], []]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    asked = F.array(F.lit(1.0), F.lit(0.0))
    assert [r[0] for r in rows.orderBy("id").select(vectors.cosine_distance(F.col("v"), asked)).collect()] == [0.0, 1.0, 2.0, None]


def test_signals_are_never_filtered_out(spark):
    texts = ["KAZADA YARALANDI", "kazada yaralandi", "Kazada YARALANDİ", "ÖLÜ var", "KIRIK kol", "Röntgenim çekildi", "RONTGENE girdi", "acil  servise", "ACİL SERVİSE kaldırıldı", "iyi"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(signals(F.col("t"))).collect()]
    assert found == [SignalRules().find(t) for t in texts]
    assert sum(map(bool, found)) >= 6


class Patterns(SignalRules):
    """The same rules, term by term with a pattern for each spelling."""

    def find(self, text):
        fold = str.maketrans("çğıöşü", "cgiosu")
        low = (text or "").replace("I", "ı").replace("İ", "i").lower()
        folded, out = low.translate(fold), []
        for term in self.terms:
            plain = term.replace("I", "ı").replace("İ", "i").lower()
            for seen, spelling in ((low, plain), (folded, plain.translate(fold)))[: 1 if term in self.never_folded else 2]:
                spans = [m.span() for m in re.finditer(f"(?<![{self.word_letters}])" + re.escape(spelling), seen)]
                if any(self.holds(folded, a, b, term in self.context_terms) for a, b in spans):
                    out.append(term)
                    break
        return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["yaralı", "YARALANMA", "yok", "var mı", ":", "\n", "hastane", "ye kaldır", "ağrı kesici", "kan kayb", "ölü", "olu", "kırık", "x", "değil", "mi", "ambulans geldi", " "]), max_size=12), st.booleans())
def test_automaton_against_patterns(parts, joined):
    text_ = ("" if joined else " ").join(parts)
    assert SignalRules().find(text_) == Patterns().find(text_)


def test_ten_thousand_terms(spark, sf):
    """Time hardly grows with terms, and the terms found are those of patterns."""
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    words = sorted({w.strip(".,!?;:").lower() for t in texts for w in t.split() if len(w) > 4})
    some = [t for t in texts if len(t) < 2000][:12]
    many = SignalRules(terms=tuple([*words[:5000], *(f"none{k}" for k in range(5000))][:10_000]), context_terms=frozenset(words[:50]))
    assert [many.find(t) for t in some[:3]] == [Patterns(terms=many.terms, context_terms=many.context_terms).find(t) for t in some[:3]]
    few = SignalRules(terms=tuple(words[:3]))

    def seconds(rules):
        rules.find("")
        began = time.process_time()
        for t in texts:
            rules.find(t)
        return time.process_time() - began

    assert seconds(many) < 40 * seconds(few) + 2  # 3000 times as many terms


def test_masking_joins_no_text(spark):
    """A short dictionary masks each text where it is: no join and no shuffle."""
    df = spark.createDataFrame([(1, "Ali 0532 111 22 33"), (1, "“Ali” ΑΣ. (veli)"), (None, None)], "id int, text string")
    found = masking.mask_all(df, "id", "text", spark.createDataFrame([("ali",), ("Veli",), ("ας",)], "name string"))
    assert "Join" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan
    assert sorted(str(r[0]) for r in found.select("masked_text").collect()) == ["None", "[NAME_1] [PHONE_1]", "“Ali” [NAME_1]. ([NAME_2])"]


def test_documents_are_triaged_once(spark, tmp_path):
    rows = [(1, "Ahmet aradı", "en", "src0"), (1, "x", "en", "src1"), (2, "  ", "en", "src0"), (3, None, None, None), (None, "y", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["triaged_documents"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert_same(found.toPandas(), connect(str(tmp_path)).sql(registry.ORACLES["triaged_documents"]).df())


@given(st.text(st.characters(codec="utf-8") | st.sampled_from("IİıçÇğĞöÖşŞüÜΣ")))
def test_lowered_and_folded(said):
    low = said.translate({ord("I"): "ı", ord("İ"): "i"}).lower()
    assert text.lowered(said) == low
    assert text.folded(low) == low.translate(str.maketrans(text.LETTERS_FROM, text.LETTERS_TO))


@pytest.mark.parametrize("name", ["injury_signals", "asserted_signals", "triaged_documents"])
def test_whole_texts_go_to_python_in_modest_batches(spark, sf, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        registry.QUERIES[name](spark, sf)
        assert int(spark.conf.get(key)) <= 2000
    finally:
        spark.conf.set(key, before)
