"""Masking of personal data, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import fold_ascii, words

#: Patterns in the order in which they are applied.
TURKISH_PATTERNS = {
    "TC": r"\b[1-9][0-9]{10}\b",
    "PHONE": r"\b(0?5\d{2}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2})\b",
    "PLATE": r"\b(\d{2}\s?[A-ZÇĞİÖŞÜ]{1,3}\s?\d{1,4})\b",
    "IBAN": r"\bTR\d{24}\b",
}
GENERAL_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "IP": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "DIGITS": r"\b\d{9,16}\b",
}
#: First names known without a dictionary, in ASCII.
STARTER_NAMES = (
    "ahmet mehmet mustafa ali huseyin hasan ibrahim ismail osman yusuf murat omer ramazan kadir suleyman abdullah yasar riza salih kemal sinan ayse fatma "
    "emine hatice zeynep elif meryem sultan hanife havva zehra esra busra seda merve ozlem derya aysel sevim nur gul seyma cagri gokhan"
).split()
#: Names that are common words too, surnames, and words that announce a name.
AMBIGUOUS_NAMES = "deniz yagmur bahar gunes umut nur gul doga ozgur ece ipek baris deren ada ekin ceylin sema".split()
SURNAMES = "yilmaz kaya demir sahin celik yildiz yildirim ozturk aydin ozdemir arslan dogan kilic aslan cetin kara koc kurt polat korkmaz".split()
NAME_MARKERS = ("sayin", "ad soyad", "adi soyadi", "imza", "saygilarimla")
#: Words before an ambiguous name in which a marker is looked for.
LOOKBACK = 4
EDGES = ".,!?;:\"'()"
#: Dictionaries of up to so many names are met inside each row, without moving texts; longer ones by a join.
NAMES_IN_ROW = 1000

MAPPINGS = "array<struct<placeholder:string,real_value:string,pii_type:string>>"


def _placeholders(name: str, kind: str):
    """Values and their places to mappings with numbered placeholders."""
    placeholder = lambda i: F.concat(F.lit(f"[{name}_"), (i + 1).cast("string"), F.lit("]"))
    return lambda v, i: F.struct(placeholder(i).alias("placeholder"), v.alias("real_value"), F.lit(kind).alias("pii_type"))


def pattern_mappings(text: Column, patterns: dict[str, str] | None = None, prefix: str = "") -> Column:
    """The personal values of a text with their placeholders, type by type in order of first occurrence. A value
    found before, by whichever type, gets no second placeholder."""
    parts, earlier = [], []
    for kind, pattern in (patterns or TURKISH_PATTERNS).items():
        values = F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))
        new = F.array_except(values, F.concat(*earlier)) if earlier else F.array_distinct(values)
        parts.append(F.transform(new, _placeholders(prefix + kind, kind)))
        earlier.append(values)
    return F.coalesce(F.concat(*parts), F.array().cast(MAPPINGS))


def apply_mappings(text: Column, mappings: Column) -> Column:
    """Every value replaced by its placeholder, wherever it stands, in order."""
    return F.aggregate(mappings, text, lambda acc, m: F.replace(acc, m["real_value"], m["placeholder"]))


def unmask(text: Column, mappings: Column) -> Column:
    """Every placeholder of the mappings replaced by its value; others stay."""
    return F.aggregate(mappings, text, lambda acc, m: F.replace(acc, m["placeholder"], m["real_value"]))


def unmask_struct(df: DataFrame, column: str, mappings: Column) -> Column:
    """A struct column with the placeholders in its strings replaced, in nested structs too; arrays stay."""

    def walk(value: Column, kind) -> Column:
        if kind.typeName() == "struct":
            fields = [walk(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        return unmask(value, mappings) if kind.typeName() == "string" else value

    return walk(F.col(column), df.schema[column].dataType)


def mask_question(question: Column) -> Column:
    """struct(text, mappings) by patterns only, with placeholders of their own space, [Q_..._n]."""
    mappings = pattern_mappings(question, prefix="Q_")
    return F.struct(apply_mappings(question, mappings).alias("text"), mappings.alias("mappings"))


def has_question_placeholder(text: Column) -> Column:
    return text.rlike(r"\[Q_[A-Z_]*_\d+\]")


def with_pattern_masks(df: DataFrame, text_col: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """df with masked_text and mappings, by patterns only."""
    return df.withColumn("mappings", pattern_mappings(F.col(text_col), patterns)).withColumn("masked_text", apply_mappings(F.col(text_col), F.col("mappings")))


def with_name_masks(df: DataFrame, id_col: str, text_col: str, names: DataFrame, start: Column | None = None) -> DataFrame:
    """df with masked_text and mappings of texts whose words are names of the dictionary (a column name).

    Words are compared without edge punctuation, folded to ASCII. A name that is a common word counts only beside a
    surname or within LOOKBACK words after a marker. Each occurrence gets a number of its own, after `start`;
    white space collapses to single blanks. A short dictionary is looked up in each row, which moves no text;
    with a long one words are exploded and joined, so that neither has to fit anywhere, and only the names found
    are gathered by text. Ids must be distinct then, and texts without one are left out.
    """
    listed = names.select(fold_ascii(F.col(names.columns[0])).alias("folded")).where("folded != ''").distinct()
    texts = df.withColumns({"_start": F.lit(0) if start is None else start, "_words": words(F.col(text_col))})
    few = [r[0] for r in listed.limit(NAMES_IN_ROW + 1).collect()]
    if len(few) <= NAMES_IN_ROW:
        # folding changes no white space, so that a text folded whole has the same words
        texts = texts.withColumn("_folded", words(fold_ascii(F.col(text_col))))
        places = F.array_compact(F.transform("_folded", lambda w, k: F.when(F.btrim(w, F.lit(EDGES)).isin(few), k)))
        word, folded = (lambda k: F.get("_words", k)), (lambda k: F.btrim(F.get("_folded", k), F.lit(EDGES)))
        named = lambda k: F.struct(k.alias("pos"), word(k).alias("word"), F.btrim(word(k), F.lit(EDGES)).alias("bare"), folded(k).alias("folded"))
        joined = texts.withColumn("_places", places).withColumn("_found", F.transform("_places", named)).drop("_places", "_folded")
    else:
        bare = F.btrim("word", F.lit(EDGES))
        tokens = texts.select(id_col, F.posexplode("_words").alias("pos", "word")).select(id_col, "pos", "word", bare.alias("bare"), fold_ascii(bare).alias("folded"))
        found = tokens.join(listed, "folded").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "bare", "folded"))).alias("_found"))
        joined = texts.where(F.col(id_col).isNotNull()).join(found, id_col, "left")

    def surname(pos: Column) -> Column:
        near = lambda k: fold_ascii(F.btrim(F.get("_words", k), F.lit(EDGES))).isin(SURNAMES)
        return F.coalesce(near(pos + 1), F.lit(False)) | ((pos > 0) & F.coalesce(near(F.greatest(pos - 1, F.lit(0))), F.lit(False)))

    def marked(pos: Column) -> Column:
        begin = F.greatest(pos - LOOKBACK, F.lit(0))
        before = fold_ascii(F.array_join(F.slice("_words", begin + 1, pos - begin), " "))
        return before.rlike("|".join(NAME_MARKERS))

    ambiguous = lambda x: x["folded"].isin(AMBIGUOUS_NAMES)
    joined = joined.withColumn("_found", F.filter("_found", lambda x: ~ambiguous(x) | surname(x["pos"]) | marked(x["pos"])))
    placeholder = lambda k: F.concat(F.lit("[NAME_"), (F.col("_start") + k + 1).cast("string"), F.lit("]"))
    begins = lambda k: F.when(k > 0, F.get("_found", F.greatest(k - 1, F.lit(0)))["pos"] + 1).otherwise(0)
    until = lambda x, k: F.slice("_words", begins(k) + 1, x["pos"] - begins(k))
    pieces = F.flatten(F.transform("_found", lambda x, k: F.concat(until(x, k), F.array(F.replace(x["word"], x["bare"], placeholder(k))))))
    rest = F.element_at("_found", -1)["pos"] + 1
    masked = F.array_join(F.concat(pieces, F.slice("_words", rest + 1, F.size("_words") - rest)), " ")
    mappings = F.transform("_found", lambda x, k: F.struct(placeholder(k).alias("placeholder"), x["bare"].alias("real_value"), F.lit("NAME").alias("pii_type")))
    some = F.coalesce(F.size("_found"), F.lit(0)) > 0
    masks = {"masked_text": F.when(some, masked).otherwise(F.array_join("_words", " ")), "mappings": F.when(some, mappings).otherwise(F.array().cast(MAPPINGS))}
    return joined.withColumns(masks).drop("_start", "_words", "_found")


def mask_names(df: DataFrame, id_col: str, text_col: str, names: DataFrame, start: Column | None = None) -> DataFrame:
    """id, masked_text and mappings of texts, as with_name_masks() gives them."""
    texts = df.select(F.col(id_col), F.col(text_col).alias("_text"), (F.lit(0) if start is None else start).alias("_first"))
    return with_name_masks(texts, id_col, "_text", names, F.col("_first")).select(id_col, "masked_text", "mappings")


def with_all_masks(df: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """df with masked_text and mappings: patterns first, then names in what the patterns left. Each text is read once, and not joined with itself."""
    by_pattern = with_pattern_masks(df, text_col).withColumnRenamed("mappings", "_by_pattern")
    return with_name_masks(by_pattern, id_col, "masked_text", names).withColumn("mappings", F.concat("_by_pattern", "mappings")).drop("_by_pattern")


def mask_all(df: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """id, masked_text and mappings, as with_all_masks() gives them."""
    return with_all_masks(df.select(id_col, text_col), id_col, text_col, names).select(id_col, "masked_text", "mappings")
