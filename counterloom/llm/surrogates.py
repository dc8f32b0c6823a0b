"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities are found by one pattern. Each distinct entity gets one surrogate for the whole corpus, drawn from a keyed digest of its
canonical form, so all its mentions stay equal in every document and spelling. A surrogate keeps type and form: an email
address stays one with its last domain label, a card number keeps network digit, grouping and a valid check digit, a
phone number its country code and punctuation, an address has four valid octets, a secret its alphabet, a name its gender (a neutral
title gets a neutral name), script, number of words, initials, hyphens, particles and what stands before an apostrophe.
Letter case and separators follow the mention. A name of several words is also replaced where the same text has it without a title.

Collision checks keep entities distinct: no surrogate is shared by two entities of a type, and none equals an entity found in the corpus;
the later entities of a clash draw again until no clash is left.

Null and empty texts are returned as they are. Repeated rows get equal texts. Null ids and extra columns are kept; no row is
added or lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

# --- fixed values: titles, issuer prefixes, name parts -----------------------------------------------------------------
TITLES_M = "Mr|Herr|Señor|Monsieur|Господин|Κύριος"
TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Madame|Госпожа|Κυρία"
TITLES_X = "Dr|Prof|Professor|Доктор|Δρ"
PARTICLES = "van von der den de da di du la le bin al".split()
CARD_ISSUERS = (
    r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:2[2-9]|[3-6]\d|7[01])\d{13}|3[47]\d{13}|6(?:011|5\d\d|4[4-9]\d)\d{12}"
    r"|35(?:2[89]|[3-8]\d)\d{12}|3(?:0[0-5]|[68]\d)\d{11}|62\d{14})$"
)
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Louis Martin Noah Oscar Paul Robert Simon Thomas Victor",
    ("f", "latin"): "Anna Berta Clara Diana Emma Flora Greta Helena Ines Julia Klara Laura Marta Nina Olga Paula Rosa Sofia Tina Vera",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Николай Олег Павел Роман Сергей Тимур Фёдор Юрий Яков",
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Ева Зоя Инна Кира Лидия Мария Нина Ольга Полина Раиса Софья Тамара Ульяна Юлия Яна",
    ("x", "latin"): "Alex Charlie Chris Dana Jamie Jordan Kim Morgan Robin Sascha",
    ("x", "cyrillic"): "Валя Женя Саша Шура",
    ("m", "greek"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μάρκος Νίκος Πέτρος Στέφανος",
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ζωή Κατερίνα Μαρία Σοφία Χριστίνα",
    ("x", "greek"): "Άλεξ Ντάνι Σάσα",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ha he ho ka ke ko la le lo ma me mo na ne no ra re ro sa se",
    "greek": "βα βε βο γα γε γο δα δε δο ζα ζε ζο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο",
    "cyrillic": "ба бе бо ва ве во га ге го да де до жа же жо за зе зо ка ке ко ла ле ло ма ме мо на не но ра ре",
}
# -------------------------------------------------------------------------------------------------------------------------

SECRET_NAME = r"""(?i:(?<![\p{L}\p{N}])(?:token|secret|password|passwd|pwd|api[_-]?key|auth[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)"""
#: The whole value whatever its length, with inner dots; dots that end it belong to the sentence.
SECRET = SECRET_NAME + r"[0-9A-Za-z_+/=.-]{7,}[0-9A-Za-z_+/=-]"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,4}\.\p{L}{2,24}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ADDRESS = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
# titles in capitals, but for those that are common abbreviations of something else
MALE, FEMALE = (f"{t}|{'|'.join(x for x in t.upper().split('|') if x != 'MS')}" for t in (TITLES_M, TITLES_F))
TITLE = rf"\b(?:{MALE}|{FEMALE}|{TITLES_X})\.? "
_NEXT = rf"(?!(?:{MALE}|{FEMALE}|{TITLES_X})\b)(?!{SECRET_NAME})"  # no word of a name
PART = _NEXT + rf"\p{{Lu}}(?:[\p{{L}}\p{{M}}]++|(?=['’]\p{{Lu}}))(?:['’-]{_NEXT}\p{{Lu}}[\p{{L}}\p{{M}}]++)*+"
_WORD = rf"(?:\p{{Lu}}\.|{PART}|{'|'.join(PARTICLES)}) "
PERSON = rf"{TITLE}(?:{_WORD}){{0,3}}{PART}"
#: Words that may be a name without title; they must not begin an email address.
BARE = rf"(?<![\p{{L}}\p{{N}}._%+@'’-])(?=\p{{Lu}})(?:{_WORD}){{1,3}}{PART}(?![\p{{L}}\p{{N}}._%+-]*@)"
PHONE = PHONE.replace(r"([.-])\d{3}\1", r"(?:-\d{3}-|\.\d{3}\.)")  # without a group, which splitting would not mind but reading does
PATTERN = "|".join((SECRET, EMAIL, ADDRESS, SOCIAL, PHONE, CARD, PERSON))
WITH_BARE = f"{PATTERN}|{BARE}"
#: Every entity has a digit, an @ or a title: a quick test before the pattern.
HINT = rf"[0-9@]|{TITLE}|(?i:token|secret|passw|pwd|key)"

_STREAM = 128  # pseudo-random bytes per entity and attempt


def _stream(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    seed = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), canonical)
    return F.concat(F.sha2(F.concat(seed, F.lit("\x1f0")), 512), F.sha2(F.concat(seed, F.lit("\x1f1")), 512))


def _byte(stream: Column, i: Column | int) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(stream, (i % _STREAM) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(text: str, at: Column) -> Column:
    return F.substring(F.lit(text), at % len(text) + 1, F.lit(1))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _like(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Another character of the same kind and script for each letter and digit."""

    def other(c: Column, i: Column, s: Column) -> Column:
        v = _byte(s, i)
        return (
            F.when(hexadecimal & c.rlike("^[0-9a-f]$"), _pick("0123456789abcdef", v)).when(c.rlike("^[0-9]$"), _pick("0123456789", v))
            .when(c.rlike(r"^\p{IsCyrillic}$"), _pick("абвгдежзиклмнопрстуфхцчшэюя", v)).when(c.rlike(r"^\p{IsGreek}$"), _pick("αβγδεζηθικλμνξοπρστυφχψω", v))
            .when(c.rlike(r"^\p{L}$"), _pick("abcdefghijklmnopqrstuvwxyz", v)).otherwise(c)
        )

    # the stream is bound once: a long secret would else hash itself for each of its characters
    return F.transform(F.array(stream), lambda s: F.array_join(F.transform(_chars(text), lambda c, i: other(c, i, s)), ""))[0]


def _luhn(digits: Column, check_missing: bool = False) -> Column:
    """Weighted digit sum of a card number; with the check digit missing, as if it were 0."""
    shift = 1 if check_missing else 0

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((i + shift) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.reverse(_chars(digits)), weighed), F.lit(0), lambda a, x: a + x)


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def kind_of(raw: Column) -> Column:
    """Type of an entity as found; null for digits that are no card number."""
    card = _digits(raw)
    return (
        F.when(raw.rlike("^" + SECRET_NAME), "secret").when(raw.contains("@"), "email").when(raw.rlike(rf"^(?:{MALE})\b"), "person_m")
        .when(raw.rlike(rf"^(?:{FEMALE})\b"), "person_f").when(raw.rlike(rf"^(?:{TITLES_X})\b"), "person_x").when(raw.rlike(f"^{BARE}$"), "bare").when(raw.rlike(f"^{ADDRESS}$"), "address").when(raw.rlike(f"^{SOCIAL}$"), "social")
        .when(raw.rlike(f"^(?:{CARD})$"), F.when(card.rlike(CARD_ISSUERS), F.when(_luhn(card) % 10 == 0, "card"))).otherwise("phone")
    )


def _value(raw: Column, kind: Column) -> Column:
    """The part of a mention that is replaced: without the name of a secret or a person's title."""
    return F.when(kind == "secret", F.regexp_replace(raw, "^" + SECRET_NAME, "")).when(kind.startswith("person"), F.regexp_replace(raw, "^" + TITLE, "")).otherwise(raw)


def canonical_of(raw: Column, kind: Column) -> Column:
    """Equal for all spellings of an entity."""
    value = _value(raw, kind)
    return F.when(kind.isin("card", "social"), _digits(raw)).when(kind == "phone", F.regexp_replace(raw, "[^0-9+]", "")).otherwise(F.lower(F.translate(value, "’", "'")))


def draw(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """Surrogate of a canonical entity, in canonical form (names in their usual case)."""
    s = _stream(key, kind, canonical, attempt)
    no = F.lit(False)
    domain = F.regexp_extract(canonical, r"@(.*)\.[^.]*$", 1)
    email = F.concat(_like(F.substring_index(canonical, "@", 1), s, no), F.lit("@"), _like(domain, F.reverse(s), no), F.lit("."), F.substring_index(canonical, ".", -1))
    body = F.concat(F.substring(canonical, 1, 1), _like(F.substring(canonical, F.lit(2), F.length(canonical) - 2), s, no))
    card = F.concat(body, ((10 - _luhn(body, True) % 10) % 10).cast("string"))
    code = F.when(canonical.startswith("+"), F.when(canonical.rlike(r"^\+[17]"), 2).otherwise(3)).otherwise(0)
    phone = F.concat(F.substring(canonical, F.lit(1), code), _like(F.substring(canonical, code + 1, F.length(canonical)), s, no))
    address = F.concat_ws(".", (_byte(s, 0) % 223 + 1).cast("string"), *(_byte(s, i).cast("string") for i in (1, 2, 3)))
    secret = _like(canonical, s, canonical.rlike("^[0-9a-f]+$"))


    def by_script(of) -> Column:
        return F.when(canonical.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(canonical.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))

    given = F.when(kind == "person_m", by_script(lambda t: F.split(F.lit(GIVEN["m", t]), " "))).when(kind == "person_f", by_script(lambda t: F.split(F.lit(GIVEN["f", t]), " ")))
    given = given.otherwise(by_script(lambda t: F.split(F.lit(GIVEN["x", t]), " ")))
    syllables = by_script(lambda t: F.split(F.lit(SYLLABLES[t]), " "))
    words = F.split(canonical, " ")
    pick = lambda options, i: F.element_at(options, _byte(s, i) % F.size(options) + 1)

    def word(w: Column, i: Column) -> Column:
        def piece(at: Column) -> Column:
            # each further attempt adds a syllable, so that names cannot run out
            family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 3), lambda k: pick(syllables, at + k)), ""))
            return F.when(i == F.size(words) - 1, family).otherwise(pick(given, at))

        hyphened = F.array_join(F.transform(F.split(w, "-"), lambda p, j: piece(i * 11 + j * 5)), "-")
        before = F.initcap(F.regexp_extract(w, "^[^-]*'", 0))
        return F.when(w.rlike(r"^\p{L}\.$"), F.concat(F.upper(F.substring(pick(syllables, i * 11), 1, 1)), F.lit("."))).when(w.isin(PARTICLES), w).otherwise(F.concat(before, hyphened))

    person = F.array_join(F.transform(words, word), " ")
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "address", address)
        .when(kind == "secret", secret).when(kind.startswith("person"), person).otherwise(_like(canonical, s, no))
    )


def _rendered(raw: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate with the case and separators of the mention."""
    value = _value(raw, kind)
    before = F.substring(raw, F.lit(1), F.length(raw) - F.length(value))

    def cased(c: Column, new: Column) -> Column:
        return F.when(c.rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new)

    digits = _digits(surrogate)
    digit = lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(raw, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    by_digit = F.array_join(F.transform(_chars(raw), digit), "")
    by_char = F.when(value == F.upper(value), F.upper(surrogate)).otherwise(F.array_join(F.zip_with(_chars(value), _chars(surrogate), cased), ""))
    name = F.when(value == F.upper(value), F.upper(surrogate)).otherwise(surrogate)
    return (
        F.when(kind.isin("card", "social", "phone"), by_digit).when(kind == "address", surrogate).when(kind.startswith("person"), F.concat(before, name))
        .otherwise(F.concat(before, F.when(F.length(value) == F.length(surrogate), by_char).otherwise(surrogate)))
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """A surrogate for each distinct (kind, canonical): written table of (kind, canonical, surrogate).

    Each round draws for the entities that have none, keeps the first of those that drew the same and drops what equals an
    entity or an earlier surrogate. Names are compared in lower case, as entities are.
    """
    known = written(entities.select("kind", "canonical").distinct(), "entities")
    taken = known.select("kind", F.col("canonical").alias("drawn"))
    pending, done, attempt = known, None, 0
    while True:
        drawn = pending.withColumn("surrogate", draw(key, F.col("kind"), F.col("canonical"), F.lit(attempt)))
        first = drawn.withColumn("drawn", F.lower("surrogate")).groupBy("kind", "drawn").agg(F.min("canonical").alias("canonical"), F.min_by("surrogate", "canonical").alias("surrogate"))
        won = written(first.join(taken, ["kind", "drawn"], "left_anti"), "surrogates")
        done = won if done is None else done.unionByName(won)
        pending = written(pending.join(won, ["kind", "canonical"], "left_anti"), "clashes")
        if pending.isEmpty():
            return done.select("kind", "canonical", "surrogate")
        taken, attempt = taken.unionByName(won.select("kind", "drawn")), attempt + 1


def _unused(names: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column is called so."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _untitled(mentions: DataFrame) -> DataFrame:
    """Names without title that their text has with one: (_text_key, _at, kind, canonical, before, inner, after) of each such mention.

    Neighbouring words may begin with a capital as well, so every run of two or more words of a mention, of five at most, is looked up.
    """
    names = mentions.where(F.col("kind").startswith("person") & F.col("canonical").contains(" ")).groupBy("_text_key", "canonical").agg(F.min("kind").alias("kind"))
    words = F.split("raw", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.transform(F.sequence(F.lit(2), F.size(words) - i + 1), lambda n: F.struct(i.alias("i"), n.alias("n")))))
    join = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    looked = mentions.where("kind = 'bare'").select("_text_key", "_at", "raw", F.explode(runs).alias("x")).select(
        "_text_key", "_at", "x.n", join(F.lit(1), F.col("x.i") - 1).alias("before"), join(F.col("x.i"), F.col("x.n")).alias("inner"),
        join(F.col("x.i") + F.col("x.n"), F.size(words)).alias("after"),
    )
    hits = looked.withColumn("canonical", F.lower(F.translate("inner", "’", "'"))).join(names, ["_text_key", "canonical"])
    best = F.max_by(F.struct("kind", "canonical", "before", "inner", "after"), F.struct("n", F.col("before")))
    return hits.groupBy("_text_key", "_at").agg(best.alias("x")).select("_text_key", "_at", "x.*")


def replace_personal_data(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with entities replaced in ``text``, and as last column ``_replaced``, the number of mentions
    replaced; the column has further underscores where ``docs`` has one of this name.

    Mentions are handled once per distinct text: exploded, joined to the surrogates (a frequent entity is a large group of that
    join, which adaptive execution splits) and gathered by text in their order.
    """
    text_key, count = _unused(docs.columns, "_text_key"), _unused(docs.columns, "_replaced")
    new_names = _unused([*docs.columns, text_key, count], "_new")
    titled = F.col(text).rlike(TITLE)
    found = F.coalesce(F.col(text).rlike(HINT) & F.col(text).rlike(PATTERN), F.lit(False))
    hits = docs.where(found).withColumn(text_key, F.sha2(text, 256))
    raws = F.when(titled, F.regexp_extract_all(F.col(text), F.lit(WITH_BARE), F.lit(0))).otherwise(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))
    mentions = (
        hits.select(F.col(text_key).alias("_text_key"), raws.alias("_raws")).dropDuplicates(["_text_key"])
        .select("_text_key", F.posexplode("_raws").alias("_at", "raw")).withColumn("kind", kind_of(F.col("raw"))).withColumn("canonical", canonical_of(F.col("raw"), F.col("kind")))
    )
    mentions = written(mentions, "mentions")
    surrogates = assign(mentions.where("kind <> 'bare'"), key)
    again = _untitled(mentions).withColumnsRenamed({"kind": "_kind", "canonical": "_canonical"})
    named = mentions.join(again, ["_text_key", "_at"], "left").withColumns({"kind": F.coalesce("_kind", "kind"), "canonical": F.coalesce("_canonical", "canonical"), "raw_": F.coalesce("inner", "raw")})
    named = named.join(surrogates, ["kind", "canonical"], "left")
    rendered = F.when(F.col("surrogate").isNotNull(), _rendered(F.col("raw_"), F.col("kind"), F.col("surrogate")))
    new = F.coalesce(F.concat_ws(" ", F.nullif("before", F.lit("")), rendered, F.nullif("after", F.lit(""))), F.col("raw"))
    new = F.when(F.col("surrogate").isNotNull(), new).otherwise(F.col("raw"))
    gathered = named.groupBy(F.col("_text_key").alias(text_key)).agg(F.array_sort(F.collect_list(F.struct("_at", new.alias("new")))).alias(new_names), F.count("surrogate").alias(count))
    between = F.when(titled, F.split(F.col(text), WITH_BARE, -1)).otherwise(F.split(F.col(text), PATTERN, -1))
    joined = F.concat(between[0], F.array_join(F.zip_with(new_names, F.slice(between, F.lit(2), F.size(between)), lambda e, rest: F.concat(e["new"], rest)), ""))
    out = hits.join(gathered, text_key).withColumn(text, joined)
    rest = docs.where(~found).withColumn(count, F.lit(0).cast("long"))
    return rest.select(*docs.columns, count).unionByName(out.select(*docs.columns, count))
