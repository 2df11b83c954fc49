"""Personal data and secrets replaced by keyed surrogates, in column functions only.

One pattern finds the entities of a text. The distinct values of all texts get
their surrogates in one table: a keyed hash chooses each character, so that a
value has the same surrogate everywhere (coreference), of the same type and
format. Collisions are checked over the whole table: if two values of a type
have one surrogate, or a surrogate is a value that occurs, the hash is taken
again for all but the smallest, until every surrogate is distinct and new.

=========  ================================================================
email      letters for letters, digits for digits; host under example.org
phone      country code and punctuation stay, digits change; + or 00 and 8 to
           15 digits in groups of any size, or nationally ddd-ddd-dddd,
           (ddd) ddd-dddd and five pairs as in 06 12 34 56 78
ip         an address in 10.0.0.0/8
card       first digit and length stay, the check digit is right; numbers
           whose check digit is wrong are no cards and stay
aws_key    AKIA and 16 capitals and digits
secret     the value after a word like ``password=``, by character classes: what
           stands in quotes on a line, else all up to a space but for the
           punctuation at its end; six characters at least, one a letter or digit
name       words after a title (Mr, Frau, г-жа): a given name of the same
           gender and script, and a family name, each with its own surrogate,
           so that a person named with and without given name stays one
=========  ================================================================

Texts without entities do not shuffle and stay byte for byte as they are. A
null text stays null. Equal texts are worked on once, whatever their number.
Every row comes back, with all its columns; ``n_entities`` is added and
replaces one of its name. The key is a secret of the caller: without it the
surrogates say nothing about the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioseek.llm.common import let
from folioseek.sources.scratch import written

# Titles by gender and script.
TITLES = {
    ("m", "latin"): ("Mr", "Herr", "Monsieur", "Señor"),
    ("f", "latin"): ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora"),
    ("m", "cyrillic"): ("г-н", "господин"),
    ("f", "cyrillic"): ("г-жа", "госпожа"),
}
# Given names by gender and script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul".split(),
    ("f", "latin"): "Alice Bella Clara Diana Emma Fiona Greta Helen Irene Julia Karen Laura Maria Nora Olivia Paula".split(),
    ("m", "cyrillic"): "Антон Борис Вадим Георгий Денис Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман Сергей".split(),
    ("f", "cyrillic"): "Алина Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Марина Нина Ольга Полина Раиса Софья".split(),
}
# Sixteen syllables of family names by script.
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на".split(),
}
# Words before a secret.
SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

_TITLES = "|".join(sorted((title for titles in TITLES.values() for title in titles), key=lambda t: (-len(t), t)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GAP = r"[ .\-/\u00a0\u202f]"
_END = r"(?!\d|[.\-/]\d)"
# Digits in groups of any size; first by the fixed lengths of +1, +7, +33 and +34, so that a number behind is not taken in.
_INTERNATIONAL = (
    rf"(?<![\d+])(?:\+[17](?:{_GAP}?\(?\d\)?){{10}}|\+3[34](?:{_GAP}?\(0\))?(?:{_GAP}?\d){{9}}"
    rf"|(?:\+\d|(?<!\d[.,/-])00[1-9](?=\d{{0,2}}{_GAP}))(?:{_GAP}?\(?\d\)?){{7,14}}){_END}"
)
# ddd-ddd-dddd with dots or spaces as well, and the five pairs of French numbers; no part of a longer row of numbers.
_NATIONAL = (
    rf"(?<![\p{{L}}\d+])(?<!\d[.,/-])(?:(?:1[.-])?\d{{3}}(?:-\d{{3}}-|\.\d{{3}}\.)\d{{4}}|0[1-9](?:(?:-\d\d){{4}}|(?:\.\d\d){{4}})"
    rf"|(?<!\d[ \u00a0\u202f])(?:\d{{3}} \d{{3}} \d{{4}}|0[1-9](?:[ \u00a0\u202f]\d\d){{4}}(?![ \u00a0\u202f]\d\d(?!\d)))){_END}"
)
_CODED = r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?|\(\d{3}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)"
_SECRET_HEAD = rf"(?<![A-Za-z])(?i:{'|'.join(SECRET_WORDS)})\s{{0,3}}[=:]\s{{0,3}}"
# Up to the closing quote of the line, over escaped ones; possessive, as a value may be of any length.
_QUOTED = "|".join(
    rf"{q}(?=[^{q}\r\n]{{6}})(?=[^{q}\r\n]*?[\p{{L}}\p{{N}}])(?:[^{q}\\\r\n]++|\\[^\r\n])++(?={q})" for q in "\"'"
)
# Without quotes, or where a quote is not closed on the line: up to a space, without the punctuation at the end.
_CLOSING = r".,;:!?)\]}>\"'"
_BARE = rf"(?:\"(?![^\"\r\n]*+\")|'(?![^'\r\n]*+')|(?![\"']))(?=\S{{5,}}?[^\s{_CLOSING}])(?=\S*?[\p{{L}}\p{{N}}])(?:[{_CLOSING}]*+[^\s{_CLOSING}]++)++"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "phone": rf"{_INTERNATIONAL}|{_NATIONAL}|{_CODED}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<!\d)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\d)",
    "aws_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"{_SECRET_HEAD}(?:{_QUOTED}|{_BARE})",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}})?(?!\p{{L}})",
}
ENTITY = "|".join(f"(?:{pattern})" for pattern in PATTERNS.values())
_HEAD = rf"(?s)^((?i:{'|'.join(SECRET_WORDS)})\s*[=:]\s*[\"']?|(?:{_TITLES})\.? )(.*)$"


def _kind(entity: Column) -> Column:
    chosen = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        # What follows a secret is not part of the entity, so its head tells it.
        whole = f"^{_SECRET_HEAD}" if kind == "secret" else f"^(?:{PATTERNS[kind]})$"
        chosen = F.when(F.regexp_like(entity, F.lit(whole)), kind).otherwise(chosen)
    return chosen


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _check_sum(digits: Column) -> Column:
    """The sum that is a multiple of ten if the last of the digits is the right check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda total, d: total + d)


def _gender(title: Column) -> Column:
    chosen = F.lit("m")
    for (gender, _), titles in TITLES.items():
        chosen = F.when(title.isin(*titles), gender).otherwise(chosen)
    return chosen


def pieces(entity: Column) -> Column:
    """What is replaced in an entity: its fixed head and the values behind it with their kinds.

    An array of ``(head, kind, value)``; the head of a name is its title, that
    of a secret the word before it. A number that is no card has no piece.
    """

    def piece(kind: Column, value: Column, head: Column | None = None) -> Column:
        return F.struct((head if head is not None else F.lit("")).alias("head"), kind.alias("kind"), value.alias("value"))

    head, rest = F.regexp_extract(entity, _HEAD, 1), F.regexp_extract(entity, _HEAD, 2)
    parts = F.split(rest, " ")
    script = F.when(F.regexp_like(rest, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")
    gender = _gender(F.regexp_replace(head, r"\.? $", ""))
    family = F.concat(F.lit("family-"), script)
    given = F.concat(F.lit("given-"), gender, F.lit("-"), script)
    name = F.when(F.size(parts) == 1, F.array(piece(family, rest, head))).otherwise(
        F.array(piece(given, parts[0], head), piece(family, F.get(parts, F.lit(1))))
    )

    def of(kind: Column) -> Column:
        plain = F.array(piece(kind, entity))
        return (
            F.when(kind == "name", name)
            .when(kind == "secret", F.array(piece(kind, rest, head)))
            .when((kind == "card") & (_check_sum(_digits(entity)) % 10 != 0), F.slice(plain, 1, 0))
            .otherwise(plain)
        )

    return let(_kind(entity), of)


def _stream(key: str, count: Column) -> Column:
    """Keyed hexadecimal digits for a value: two for each of its ``count`` characters and more."""
    # Each block hashes the seed; a long value goes into it as its digest.
    value = F.when(F.length("value") > 1024, F.sha2("value", 256)).otherwise(F.col("value"))
    seed = F.concat_ws("\x1f", F.lit(key), F.col("kind"), value, F.col("attempt").cast("string"))
    blocks = F.sequence(F.lit(0), F.floor(count / 32).cast("int"))
    hashed = let(seed, lambda s: F.transform(blocks, lambda block: F.sha2(F.concat(s, F.lit("\x1f"), block.cast("string")), 256)))
    return F.array_join(hashed, "")


def _by_class(value: Column, stream: Column) -> Column:
    """Digits for digits, small letters for small letters, capitals for capitals, of any script; the rest stays."""
    small, capitals = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def character(c: Column, pair: Column) -> Column:
        number = F.conv(pair, 16, 10).cast("int")
        return (
            F.when(F.regexp_like(c, F.lit(r"\p{N}")), (number % 10).cast("string"))
            .when(F.regexp_like(c, F.lit(r"\p{Lu}")), F.substring(F.lit(capitals), number % 26 + 1, F.lit(1)))
            .when(F.regexp_like(c, F.lit(r"\p{L}")), F.substring(F.lit(small), number % 26 + 1, F.lit(1)))
            .otherwise(c)
        )

    def of(characters: Column) -> Column:
        # Pairs as an array: a place in a long string is found by walking to it.
        pairs = F.slice(F.regexp_extract_all(stream, F.lit(".."), F.lit(0)), F.lit(1), F.size(characters))
        return F.array_join(F.zip_with(characters, pairs, character), "")

    return let(F.filter(F.split(value, ""), lambda c: c != ""), of)


def _number(stream: Column, place: int) -> Column:
    return F.conv(F.substring(stream, F.lit(2 * place + 1), F.lit(2)), 16, 10).cast("int")


def surrogate(key: str) -> Column:
    """The surrogate of a row ``kind, value, attempt``."""

    def of(stream: Column) -> Column:
        value = F.col("value")
        email = F.concat(
            _by_class(F.substring_index(value, "@", 1), stream), F.lit("@"), F.translate(F.substring(F.sha2(stream, 256), 1, 8), "0123456789", "ghijklmnop"), F.lit(".example.org")
        )
        code = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(/\u00a0\u202f-])", 0)
        phone = F.concat(code, _by_class(F.expr("value").substr(F.length(code) + 1, F.length(value)), stream))
        ip = F.concat_ws(".", F.lit("10"), *[_number(stream, i).cast("string") for i in range(3)])
        digits = F.concat(F.substring(value, 1, 1), _by_class(F.substring(_digits(value), F.lit(2), F.length(_digits(value)) - 2), stream))
        check = ((10 - _check_sum(F.concat(digits, F.lit("0"))) % 10) % 10).cast("string")
        mark = F.regexp_extract(value, "[ -]", 0)
        number = F.concat(digits, check)
        card = F.when(mark == "", number).otherwise(F.concat_ws("", *[F.concat(F.substring(number, 4 * i + 1, 4), mark if i < 3 else F.lit("")) for i in range(4)]))
        chosen = (
            F.when(F.col("kind") == "email", email)
            .when(F.col("kind") == "phone", phone)
            .when(F.col("kind") == "ip", ip)
            .when(F.col("kind") == "card", card)
            .when(F.col("kind") == "aws_key", F.concat(F.lit("AKIA"), _by_class(F.substring(value, 5, 16), stream)))
        )
        for (gender, script), names in GIVEN.items():
            # Sixteen names are soon used up; each new attempt adds a second name.
            second = F.when(F.col("attempt") > 0, F.concat(F.lit("-"), F.lower(_family(stream, script, F.col("attempt"))))).otherwise("")
            name = F.concat(F.get(F.array(*map(F.lit, names)), _number(stream, 0) % len(names)), second)
            chosen = chosen.when(F.col("kind") == f"given-{gender}-{script}", name)
        for script in SYLLABLES:
            chosen = chosen.when(F.col("kind") == f"family-{script}", _family(stream, script, F.col("attempt") + 3))
        # A secret with few letters and digits has few surrogates; later attempts are longer.
        longer = F.concat(value, F.repeat(F.lit("a"), F.least(F.lit(24), F.greatest(F.lit(0), F.col("attempt") - 3))))
        hexadecimal = F.regexp_like(value, F.lit("^[0-9a-f]+$"))
        return chosen.when(hexadecimal, F.substring(stream, F.lit(1), F.length(longer))).otherwise(_by_class(longer, stream))

    return let(_stream(key, F.length("value") + 32), of)


def _family(stream: Column, script: str, length: Column) -> Column:
    syllables = F.array(*map(F.lit, SYLLABLES[script]))
    each = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(24), length).cast("int")),
        lambda i: F.get(syllables, F.conv(F.substring(stream, i + 2, F.lit(1)), 16, 10).cast("int")),
    )
    return F.initcap(F.array_join(each, ""))


def mapping(values: DataFrame, key: str) -> DataFrame:
    """``kind, value, surrogate`` for distinct ``values(kind, value)``: one to one within a kind, and no surrogate is a value."""
    tried = written(values.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(key)), "surrogates")
    while True:
        kept = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"))
        real = values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        kept = written(kept.join(real, ["kind", "surrogate"], "left").where("real is null").drop("real"), "owners")
        judged = tried.join(kept, ["kind", "surrogate"], "left").withColumn("lost", ~F.col("value").eqNullSafe(F.col("owner")))
        judged = written(judged.drop("owner"), "tried")
        if judged.where("lost").isEmpty():
            return judged.select("kind", "value", "surrogate")
        again = judged.where("lost").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).withColumn("surrogate", surrogate(key))
        tried = written(judged.where("not lost").drop("lost").unionByName(again), "surrogates")


def replaced(documents: DataFrame, key: str) -> DataFrame:
    """The documents with their entities replaced and ``n_entities``, the number of entities replaced."""
    rows = documents.drop("n_entities")
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ENTITY), F.lit(0))
    marked = rows.withColumn("entities of the text", found)
    clean = marked.where(F.size("entities of the text") == 0).drop("entities of the text").withColumn("n_entities", F.lit(0).cast("long"))
    hits = written(marked.where(F.size("entities of the text") > 0).withColumn("key of the text", F.md5("text")), "hits")
    texts = hits.groupBy(F.col("key of the text").alias("key")).agg(F.first("entities of the text").alias("entities"))
    entities = texts.select("key", F.posexplode("entities").alias("place", "entity"))
    parts = written(
        entities.select("key", "place", "entity", F.posexplode_outer(pieces(F.col("entity"))).alias("part", "piece")).select(
            "key", "place", "entity", "part", "piece.head", "piece.kind", "piece.value"
        ),
        "pieces",
    )
    values = written(parts.where("kind is not null").select("kind", "value").distinct(), "values")
    named = parts.join(mapping(values, key), ["kind", "value"], "left")
    one = (
        named.groupBy("key", "place")
        .agg(F.first("entity").alias("entity"), F.sort_array(F.collect_list(F.struct("part", "head", "surrogate"))).alias("parts"))
        .select(
            "key",
            "place",
            F.when(F.isnull(F.get("parts", F.lit(0))["surrogate"]), F.col("entity"))
            .otherwise(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["surrogate"])), " "))
            .alias("new"),
            F.get("parts", F.lit(0))["surrogate"].isNotNull().cast("long").alias("changed"),
        )
    )
    listed = F.sort_array(F.collect_list(F.struct("place", "new"))).alias("new")
    new = written(one.groupBy("key").agg(listed, F.sum("changed").alias("n_entities")), "new")
    gaps = F.split("text", ENTITY, -1)
    text = let(
        F.col("new entities"),
        lambda n: F.array_join(F.transform(gaps, lambda gap, i: F.concat(F.coalesce(F.get(n, i - 1)["new"], F.lit("")), gap)), ""),
    )
    new = new.select(F.col("key").alias("key of the new text"), F.col("new").alias("new entities"), "n_entities")
    changed = hits.join(new, F.col("key of the text") == F.col("key of the new text")).withColumn("text", text)
    return clean.unionByName(changed.select(*clean.columns))
