r"""Surrogates for personal data, in DataFrame functions only.

One pattern finds e-mail addresses, card and phone numbers, national numbers, IP addresses, bank accounts, access keys,
secrets that are assigned to a name, and names after a title. Each entity becomes atoms: a kind and a string; a name
gives one for each of its words, so that "Mrs. Ana Roth" and "Ms. Roth" keep a family name in common. Words of a text's
titled names are replaced wherever else they stand in it; initials within a name get other letters. An atom's surrogate
comes from keyed digests: digits for digits, letters for letters of their case, and names from syllables of the script
with endings of the gender of the title. All atoms of the corpus are compared: where two atoms would get one surrogate,
or a surrogate is itself an atom of the corpus, all but the first are drawn again until none is left. Equal atoms have
equal surrogates everywhere.

Texts that fail a cheap test for entities take no part in any shuffle. Others meet their surrogates by the text's digest, so that copies of
a text are handled once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Patterns of entities, the first that matches counts.
MAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+"
ACCESS = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
VALUE = r"[A-Za-z0-9_/+\-]"
#: A secret's value isn't a whole access key, and ends where a mail address begins.
SECRET = (
    r"(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key) {0,2}+[=:] {0,2}+[\"']?+"
    rf"(?!{ACCESS}(?!{VALUE}))(?:(?!{MAIL}){VALUE}){{12,}}+"
)
ACCOUNT = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
ADDRESS = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
CARD = r"(?<!\d)\d{4}(?:[ \-]?\d{4}){3}(?!\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[\-.]\d{4}|\d{3}[\-.]\d{3}[\-.]\d{4})(?!\d)"
NATIONAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
FEMALE = r"Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|[Гг]-жа|[Гг]оспожа|[Мм]иссис|[Мм]исс"
MALE = r"Mr|Herr|Monsieur|Señor|Sr|[Гг]-н|[Гг]осподин|[Мм]истер"
NEUTRAL = r"Dr|Prof|[Дд]-р|[Дд]октор|[Пп]роф|[Пп]рофессор"
#: A word of a name: inner capitals, apostrophes before capitals, hyphens. Initials may stand before any word.
PART = r"\p{Lu}(?:[\p{L}\p{M}]+|['’]\p{Lu}[\p{L}\p{M}]+)(?:['’]\p{Lu}[\p{L}\p{M}]+|-\p{L}[\p{L}\p{M}]+)*+"
INITIAL = r"\p{Lu}\."
NAME = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE}|{NEUTRAL})\.?(?: {INITIAL})*+ {PART}(?:(?: {INITIAL})*+ {PART})?"
ANY = "|".join([MAIL, ACCESS, SECRET, ACCOUNT, ADDRESS, CARD, PHONE, NATIONAL, NAME])
#: Any entity has one of these signs or a title before a capital; texts without are passed by. An access key may be all letters.
SIGNS, KEYS = r"[0-9@=:]", ("AKIA", "ASIA")
TITLED = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE}|{NEUTRAL})\.? \p{{Lu}}"
#: Parts of the titles, one of which any title has; a plain search for them spares most texts the pattern.
STEMS = "Mr Ms Miss Frau Mme Madame Señor Sr Herr Monsieur Dr Prof -жа оспожа исс -н осподин истер -р октор роф".split()
#: Rounds in which surrogates are drawn; each leaves a small share of the collisions.
MOST_DRAWS = 64
#: Setting of the session that holds the key, and the key of tests and checks, which is no secret.
KEY_SETTING, OPEN_KEY = "spark.strandwise.surrogates.key", "surrogates"
#: Syllables and endings of surrogate names, by script.
LATIN = "ba be da do fe ga jo ka li lo ma mi na ne ra so".split()
CYRILLIC = "ба ве га да зо ка ли ма не по ра ре со та фе ши".split()
KINDS = (("mail", MAIL), ("access", ACCESS), ("account", ACCOUNT), ("address", ADDRESS), ("card", CARD), ("national", NATIONAL), ("phone", PHONE))


def _whole(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def gate(text: Column) -> Column:
    """Whether a text may have an entity: a cheap test that most texts fail."""
    either = lambda parts: reduce(lambda a, b: a | b, (text.contains(p) for p in parts))
    return F.coalesce(text.rlike(SIGNS) | either(KEYS) | (either(STEMS) & text.rlike(TITLED)), F.lit(False))


def entities(text: Column) -> Column:
    """Entities of a text in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def atoms(entity: Column) -> Column:
    """Atoms (kind, value) of an entity."""
    atom = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    # a secret's value of another kind has that kind, as where it stands bare
    value = F.when(_whole(entity, SECRET), F.regexp_extract(entity, rf"{VALUE}+\z", 0)).otherwise(entity)
    kind = reduce(lambda rest, k: F.when(_whole(value, k[1]), k[0]).otherwise(rest), KINDS[::-1], F.lit("secret"))
    words = F.filter(F.split(entity, " "), lambda w: ~_whole(w, INITIAL))
    family = atom(F.lit("family"), F.element_at(words, -1))
    named = F.when(F.size(words) > 2, F.array(atom(given(entity), F.element_at(words, 2)), family)).otherwise(F.array(family))
    return F.when(_whole(entity, NAME), named).otherwise(F.array(atom(kind, value)))


def given(entity: Column) -> Column:
    """Kind of the given name in a name, by its title."""
    title = F.substring_index(entity, " ", 1)
    female, male = (title.rlike(rf"\A(?:{t})\.?\z") for t in (FEMALE, MALE))
    return F.when(female, "given f").when(male, "given m").otherwise("given")


def initial(word: Column, key: str) -> Column:
    """An initial's surrogate: another letter of its script, the same one everywhere."""
    draw = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("initial"), word), 256), 1, 6), 16, 10).cast("int")
    table = lambda letters: F.array(*map(F.lit, letters))
    letters = F.when(word.rlike(r"\p{IsCyrillic}"), table("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")).otherwise(table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = F.array_remove(letters, F.substring(word, 1, 1))
    return F.concat(F.element_at(letters, 1 + draw % F.size(letters)), F.lit("."))


def mentions(values: Column) -> Column:
    """Pattern of the given words of names, alone or side by side, as whole words; the longest first."""
    longest = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    either = F.array_join(F.transform(longest, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|")
    word = F.concat(F.lit("(?:"), either, F.lit(r")(?![\p{L}\p{M}\p{N}_])"))
    return F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_])"), word, F.lit("(?: "), word, F.lit(")*+"))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate that an atom gets at an attempt."""
    length = F.length(value)
    block = lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"), i.cast("string")), 256)
    stream = F.array_join(F.transform(F.sequence(F.lit(0), (length / 32).cast("int")), block), "")
    draw = lambda i: F.conv(F.substring(stream, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
    hexadecimal = _whole(value, "[0-9a-f]+")
    # what stays: an access key's first four characters, a phone's country, a mail address's top domain
    stays = F.when(kind == "access", 4).when(kind == "phone", F.length(F.regexp_extract(value, r"\A\+\d{1,2}(?=\D)", 0)))
    stays = F.when(kind == "account", 2).otherwise(F.coalesce(stays, F.lit(0)))
    ends = F.when(kind == "mail", length - F.length(F.substring_index(value, ".", -1))).otherwise(length)

    def other(i: Column) -> Column:
        c, r = F.substring(value, i, F.lit(1)), draw(i)
        drawn = (
            F.when(c.rlike("[0-9]"), (r % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(97 + r % F.when(hexadecimal, 6).otherwise(26)))
            .when(c.rlike("[A-Z]"), F.char(65 + r % 26))
            .otherwise(c)
        )
        return F.when((i <= stays) | (i > ends), c).otherwise(drawn)

    plain = F.array_join(F.transform(F.sequence(F.lit(1), length), other), "")
    octets = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i == 1, 1 + draw(i) % 223).otherwise(draw(i) % 255))
    quad = F.array_join(octets.cast("array<string>"), ".")

    def name(syllables: list[str], endings: tuple[str, str, str]) -> Column:
        table = F.array(*map(F.lit, syllables))
        parts = F.transform(F.sequence(F.lit(1), 3 + F.least(attempt, F.lit(8))), lambda i: F.element_at(table, 1 + draw(i) % 16))
        end = F.when(kind == "given f", endings[0]).when(kind == "given m", endings[1]).otherwise(endings[2])
        return F.initcap(F.concat(F.array_join(parts, ""), end))

    named = F.when(value.rlike(r"\p{IsCyrillic}"), name(CYRILLIC, ("на", "н", "в"))).otherwise(name(LATIN, ("na", "n", "r")))
    return F.when(kind.rlike("^(given|family)"), named).when(kind == "address", quad).otherwise(plain)


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct atoms (kind, value), each surrogate distinct from all others, of whatever kind,
    and from all atoms. Each round draws again for what collides; only whether there is any goes to the driver. A format
    with fewer free values than atoms is an error after MOST_DRAWS rounds."""
    draws = cut(found.distinct().withColumn("attempt", F.lit(0)))
    for _ in range(MOST_DRAWS):
        drawn = draws.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        taken = draws.select(F.col("value").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        drawn = drawn.join(taken.hint("merge"), "surrogate", "left")
        first = Window.partitionBy("surrogate").orderBy("attempt", "kind", "value")
        clash = F.col("real").isNotNull() | (F.row_number().over(first) > 1)
        drawn = cut(drawn.withColumn("clash", clash).select("kind", "value", "surrogate", "attempt", "clash"))
        if not drawn.where("clash").limit(1).count():
            return drawn.select("kind", "value", "surrogate")
        draws = drawn.select("kind", "value", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise ValueError(f"no distinct surrogates after {MOST_DRAWS} draws: a format has too few values")


def replace(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """The rows with surrogates in their texts and ``n_entities``; all other columns as they came.

    A null text stays null, texts without entities stay as they are, repeated rows are repeated. A column n_entities of
    the input is replaced; an empty table gives an empty table. Whole texts of any length are searched. Words of the text's own titled names count as entities
    where they stand without a title, side by side as one. The key comes from the session's KEY_SETTING unless given; set
    one and keep it secret, since OPEN_KEY, which stands in for it, lets anybody who guesses a value confirm it.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, OPEN_KEY)
    names, text = [c for c in docs.columns if c != "n_entities"], F.col("_text")
    docs = docs.select(F.col(column).alias("_text"), F.struct(*names).alias("_doc"))
    kept = {c: F.col("_doc")[c].alias(c) for c in names}
    rows = docs.where(gate(text)).select("*", F.sha2("_text", 256).alias("_key"))
    held = rows.select(F.col("_key").alias("_digest"), F.explode(F.array_distinct(entities(text))).alias("entity"))
    held = held.select("_digest", F.explode(atoms(F.col("entity"))).alias("atom")).select("_digest", "atom.kind", "atom.value")
    held = cut(held.distinct())
    # sorted, whatever Spark takes their size for: it knows nothing of how many entities a text has
    pairs = held.join(assign(held.select("kind", "value"), key).hint("merge"), ["kind", "value"])
    entry = F.struct(F.concat_ws("\x1f", "kind", "value"), F.col("surrogate"))
    maps = pairs.groupBy("_digest").agg(F.map_from_entries(F.collect_set(entry)).alias("_map"))
    rows = rows.join(maps.hint("merge"), F.col("_key") == F.col("_digest"), "left")
    of_names = F.filter(F.map_keys("_map"), lambda k: k.rlike("^(given|family)"))
    own = F.array_distinct(F.transform(of_names, lambda k: F.substring_index(k, "\x1f", -1)))
    rows = rows.withColumn("_own", F.coalesce(own, F.array().cast("array<string>")))
    has_names = F.size("_own") > 0
    pattern = F.concat(F.lit(ANY + "|"), mentions(F.col("_own")))
    # a text without a map has no entity, so only texts with one are matched again
    found = F.when(F.col("_map").isNull(), F.array().cast("array<string>"))
    found = found.when(has_names, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(entities(text))
    rows = rows.withColumn("_found", found)

    def drawn(kind: Column, value: Column) -> Column:
        return F.element_at("_map", F.concat_ws("\x1f", kind, value))

    def named(entity: Column) -> Column:
        words = F.split(entity, " ")
        rest = F.slice(words, 2, F.size(words) - 1)
        word = lambda w, i: F.when(_whole(w, INITIAL), initial(w, key)).otherwise(
            drawn(F.when(i == F.size(rest) - 1, "family").otherwise(given(entity)), w)
        )
        return F.concat_ws(" ", F.element_at(words, 1), F.array_join(F.transform(rest, word), " "))

    def mentioned(entity: Column) -> Column:
        of = lambda w: F.coalesce(*(drawn(F.lit(k), w) for k in ("family", "given f", "given m", "given")))
        return F.array_join(F.transform(F.split(entity, " "), of), " ")

    def renewed(entity: Column) -> Column:
        first = F.element_at(atoms(entity), 1)
        other = drawn(first["kind"], first["value"])
        prefix = F.regexp_extract(entity, rf"\A(.*?){VALUE}+\z", 1)
        replaced = F.when(_whole(entity, NAME), named(entity)).when(_whole(entity, SECRET), F.concat(prefix, other))
        return replaced.when(_whole(entity, ANY), other).otherwise(mentioned(entity))

    n = F.size("_found").cast("long")
    between = F.when(has_names, F.split(text, pattern, F.lit(-1))).otherwise(F.split(text, ANY, -1))
    changed = F.concat(F.transform("_found", renewed), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(between, changed, lambda a, b: F.concat(a, b)), "")
    changed_text = F.when(n > 0, whole).otherwise(text).alias(column)
    changed_rows = rows.select(*(kept | {column: changed_text}).values(), n.alias("n_entities"))
    return docs.where(~gate(text)).select(*kept.values(), F.lit(0).cast("long").alias("n_entities")).unionByName(changed_rows)
