"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

Each entity becomes another of its kind: digits become digits, letters letters of the
same case, an address keeps its numbers in range, a card number its check digit, a name its
gender and script. The surrogate is a keyed hash of the kind and the canonical form, so
one entity has one surrogate in the whole corpus, however it is written. Names are replaced
word by word: a family name becomes the same one with or without a form of address, given
name or initial, and a listed given name the same other one of the list.

Different entities must not meet in one surrogate, nor a surrogate be somebody's entity. The
distinct entities are checked for that; those that collide take the next attempt until
none do. A row only needs to know the attempts of its own colliding entities. Later
attempts draw from an ever larger space (longer names, added characters), so that the
distinct entities never use it up, however many there are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.sources.scratch import stored

# Given names by script and gender, family names by script.
GIVEN = {
    ("latin", "f"): "Mary Anna Elizabeth Sarah Laura Emma Julia Sophie Claire Helen Maria Carmen Lucia Ingrid Katharina Alice Nora Ruth Irene Teresa".split(),
    ("latin", "m"): "James John Robert Michael David Thomas Daniel Peter Paul Martin Carlos Miguel Pierre Hans Klaus Walter Oscar Victor Simon Andrew".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Γεωργία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Ανδρέας".split(),
}
FAMILY = {
    "latin": "Smith Johnson Miller Wilson Taylor Anderson Moreau Laurent Dubois Schmidt Weber Wagner Becker Garcia Lopez Torres Navarro Rossi Novak Larsen".split(),
    "cyrillic": "Волков Соколов Лебедев Козлов Новиков Морозов Павлов Семенов".split(),
    "greek": "Παππάς Οικονόμου Γεωργίου Νικολάου Αλεξίου Βασιλείου".split(),
}
# Syllables of made-up family names, by script.
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδζκλμνπρστφ" for v in "αειου"],
}
# Forms of address and the gender that they tell.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme"], "m": ["Mr", "Herr", "Señor", "Monsieur"], "": ["Dr", "Prof"]}

# Capitals that initials are exchanged among, and what may stand before a family name.
INITIALS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŁŚŠŻŽ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
PARTICLES = "van von der den de del della di da dos du la le ten ter zu".split()

_ADDRESS = ".".join([r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"] * 4).replace(".(", r"\.(")
_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_FORMS = "|".join(t for titles in TITLES.values() for t in titles)
_CAPITAL = r"\p{Lu}[\p{L}'’-]+"
# Between the first word of a name and its last: up to three initials or capitalised words, and particles.
_BETWEEN = rf"(?:(?:(?:\p{{Lu}}\.)++|{_CAPITAL}) ){{0,3}}(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?:gh[pousr]_|sk-|xox[abpr]-)[A-Za-z0-9_-]{10,}+)",
    "setting": r"(?<![A-Za-z0-9])(?i:token|password|passwd|secret|api[_-]?key)[ \t]?[=:][ \t]?[\"']?[A-Za-z0-9_+/.-]{6,}+",
    "address": rf"(?<![0-9.]){_ADDRESS}(?!\.?[0-9])",
    "card": r"(?<![0-9])\d{4}(?:[ -]?\d{4}){3}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[.-])\d{3,4}[ .-]?\d{4}(?![0-9])|(?<![0-9+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?![0-9])|(?<![0-9+])\+\d{8,14}(?![0-9])",
    "hex": r"(?<![0-9A-Za-z])(?=[a-f]*\d)[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:(?:{_FORMS})\.?|(?:{_NAMES})) {_BETWEEN}{_CAPITAL}(?![\p{{L}}])",
}
#: What a possessive or a quote adds to a word, as it begins when read backwards: one look, whatever its length.
_TAIL_BACKWARDS = r"^(['’-]*+(?:s['’]['’-]*+)*+)"
#: The same order of preference; a look at the first character spares most places all patterns.
_BY_START = [("", "email"), ("[A-Za-z]", "key setting"), ("[0-9+(]", "address card number phone"), ("[A-Z]", "account"), ("[0-9a-f]", "hex"), (r"\p{Lu}", "name")]
ENTITY = "|".join(f"{f'(?={start})' if start else ''}(?:{'|'.join(f'(?:{PATTERNS[n]})' for n in names.split())})" for start, names in _BY_START)
#: Every entity has a digit, an at-sign, an equals sign or colon, or a capitalised word behind a
#: small letter or a form of address, or starts as a key does. Few texts have none of these, but all are found fast.
TRACE = rf"[0-9@=:]| (?<=\p{{Ll}} )\p{{Lu}}|\.(?<=(?:{_FORMS})\.) \p{{Lu}}|AKIA|ASIA|sk-|gh[pousr]_|xox[abpr]-"
MOST_ATTEMPTS = 40  # below 64: a name has the attempts of its words in one number, six bits each, the last word lowest
LISTED_ATTEMPTS = 2  # attempts with a listed family name alone
LONGEST_SEED = 256
SHAPED_ATTEMPTS = 4  # attempts that keep an entity's shape to the letter


def entities(text: Column) -> Column:
    """All entities of a text, in order, as they are written."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(TRACE), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


def kind_of(entity: Column) -> Column:
    kind = F.lit("hex")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def canonical(kind: Column, entity: Column) -> Column:
    """One form of all ways to write an entity."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "phone", "number"), digits)
        .when(kind == "email", F.lower(entity))
        .when(kind == "name", _plain(F.regexp_extract(entity, r"([^ ]+)$", 1)))
        .when(kind == "account", F.regexp_replace(entity, " ", ""))
        .when(kind == "setting", _value(entity))
        .otherwise(entity)
    )


def _tail(word: Column) -> Column:
    """What a possessive or a quote adds at the end of a word, behind its second character."""
    return F.reverse(F.regexp_extract(F.reverse(F.substring(word, F.lit(3), F.length(word))), _TAIL_BACKWARDS, 1))


def _bare(word: Column) -> Column:
    """A word without its tail; a single character has no bare form."""
    return F.when(F.length(word) < 2, "").otherwise(F.substring(word, F.lit(1), F.length(word) - F.length(_tail(word))))


def _plain(word: Column) -> Column:
    return F.lower(_bare(word))


def _units(entity: Column) -> Column:
    """The words of a name without its form of address; a particle stays with the word before it."""
    return F.split(F.regexp_replace(entity, rf"^(?:{_FORMS})\.? ", ""), r" (?=\p{Lu})")


def _is_family(word: Column, place: Column) -> Column:
    """Whether a word, so many places from the end, is none of the listed given names, initials and particles."""
    return word.rlike(rf"^{_CAPITAL}$") & ((place == 0) | ~word.isin([n for names in GIVEN.values() for n in names]))


def parts_of(kind: Column, entity: Column) -> Column:
    """What has a surrogate of its own, as (own, place, entity): a name's words, else the entity itself."""
    one = F.array(F.struct(canonical(kind, entity).alias("own"), F.lit(0).alias("place"), entity.alias("entity")))

    def words(units: Column) -> Column:
        each = F.transform(units, lambda u, i: F.struct(F.regexp_extract(u, "^([^ ]+)", 1).alias("word"), (F.size(units) - 1 - i).alias("place")))
        family = F.filter(each, lambda x: _is_family(x["word"], x["place"]))
        # A writing of the word alone.
        return F.transform(family, lambda x: F.struct(_plain(x["word"]).alias("own"), x["place"].alias("place"), F.concat(F.lit("Dr "), _bare(x["word"])).alias("entity")))

    return F.when(kind == "name", _once(_units(entity), words)).otherwise(one)


def _value(entity: Column) -> Column:
    return F.regexp_replace(entity, r"^[A-Za-z_-]+[ \t]?[=:][ \t]?[\"']?", "")


def _noise(seed: Column, i: Column) -> Column:
    """The i-th keyed number from 0 to 65535."""
    digest = F.sha2(F.concat(seed, F.lit(":"), F.floor(i / 16).cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, F.pmod(i, F.lit(16)).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("long")


def _each(value: Column, change) -> Column:
    """Every character of a text changed by (character, its place); the text is cut up once, whatever its length."""
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), lambda c, i: change(c, i + 1)), "")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (n % len(letters)).cast("int") + 1, F.lit(1))


def _shaped(value: Column, seed: Column) -> Column:
    """Digits for digits and letters for letters; other signs stay."""
    return _each(value, lambda c, i: F.when(c.rlike("[0-9]"), _pick("0123456789", _noise(seed, i))).when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", _noise(seed, i)))
                 .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _noise(seed, i))).otherwise(c))


def _digits(value: Column, seed: Column, keep: Column) -> Column:
    """New digits by their number among the digits, so that separators don't matter; the first
    ``keep`` digits stay."""
    number = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9]", ""))
    return _each(value, lambda c, i: F.when(c.rlike("[0-9]") & (number(i) > keep), _pick("0123456789", _noise(seed, number(i)))).otherwise(c))


def _luhn(digits: Column) -> Column:
    """Sum of a card number's digits, every second from the right doubled; a valid one is a multiple of ten."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(
        F.pmod(n - i, F.lit(2)) == 1, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int"))
    ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))


def _card(entity: Column, seed: Column) -> Column:
    """The first digit stays, and whether the check digit is right."""
    valid = F.pmod(_luhn(F.regexp_replace(entity, "[^0-9]", "")), F.lit(10)) == 0

    def checked(made: Column) -> Column:
        zeroed = F.concat(F.substring(F.regexp_replace(made, "[^0-9]", ""), F.lit(1), F.lit(15)), F.lit("0"))
        right = F.pmod(F.lit(10) - F.pmod(_luhn(zeroed), F.lit(10)), F.lit(10)).cast("string")
        return F.when(valid, F.concat(F.regexp_replace(made, "[0-9]$", ""), right)).otherwise(made)

    return _once(_digits(entity, seed, F.lit(1)), checked)


def _added(letters: str, seed: Column, attempt: Column) -> Column:
    """Nothing for the attempts that keep the shape, then four more characters with each."""
    more = F.sequence(F.lit(1), (attempt - SHAPED_ATTEMPTS + 1) * 4)
    added = F.array_join(F.transform(more, lambda i: _pick(letters, _noise(seed, i + 4096))), "")
    return F.when(attempt < SHAPED_ATTEMPTS, F.lit("")).otherwise(added)


def _address(entity: Column, seed: Column, attempt: Column) -> Column:
    """Numbers of as many digits, each from 0 to 255; later attempts take any numbers, as versions like 1.2.3.4 have few of one digit."""
    parts = F.split(entity, r"\.")
    return F.array_join(F.transform(parts, lambda p, i: F.when(attempt >= SHAPED_ATTEMPTS, F.pmod(_noise(seed, i), F.lit(256))).when(F.length(p) == 1, F.pmod(_noise(seed, i), F.lit(10))).when(F.length(p) == 2, F.pmod(_noise(seed, i), F.lit(90)) + 10).otherwise(F.pmod(_noise(seed, i), F.lit(156)) + 100).cast("string")), ".")


def _email(entity: Column, seed: Column, attempt: Column) -> Column:
    """The last part of the domain stays."""
    lower = F.lower(entity)
    body, top = F.regexp_extract(lower, r"^(.*)\.[^.]+$", 1), F.regexp_extract(entity, r"(\.[^.]+)$", 1)
    made = F.concat(_added("abcdefghijklmnopqrstuvwxyz", seed, attempt), _shaped(body, seed))
    upper = entity == F.upper(entity)
    return F.concat(F.when(upper, F.upper(made)).otherwise(made), top)


def _list(names: list[str]) -> Column:
    return F.split(F.lit(" ".join(names)), " ")


def _syllables(syllables: list[str], seed: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(_list(syllables), F.pmod(_noise(seed, i + 2), F.lit(len(syllables))).cast("int"))), "")


def _shuffled(values: list[str], key: str) -> list[str]:
    """For each value another one, no two the same: the next in a keyed order."""
    order = sorted(values, key=lambda v: hashlib.sha256(f"{key}|given|{v}".encode()).digest())
    after = dict(zip(order, order[1:] + order[:1]))
    return [after[v] for v in values]


def _family(word: Column, attempt: Column, key: str) -> Column:
    """A family name of the same script; a possessive ending stays."""
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def made(seed: Column) -> Column:
        family = F.lit("")
        for own, names in FAMILY.items():
            first = F.get(_list(names), F.pmod(_noise(seed, F.lit(2)), F.lit(len(names))).cast("int"))
            # Then a double name; its second part has as many syllables as there were attempts.
            second = F.initcap(_syllables(SYLLABLES[own], seed, attempt))
            family = F.when(script == own, F.when(attempt < LISTED_ATTEMPTS, first).otherwise(F.concat(first, F.lit("-"), second))).otherwise(family)
        return family

    seed = F.concat_ws("|", F.lit(key), F.lit("name"), _plain(word), attempt.cast("string"))
    return F.concat(_once(seed, made), _tail(word))


def _name(entity: Column, attempt: Column, key: str) -> Column:
    """A form of address and particles stay; given names of the same gender and script, other
    initials, and family names for all other words."""
    form = F.regexp_extract(entity, rf"^((?:{_FORMS})\.? )", 1)
    given = [n for names in GIVEN.values() for n in names]
    others = [n for names in GIVEN.values() for n in _shuffled(names, key)]
    capitals, exchanged = "".join(INITIALS), "".join(c for letters in INITIALS for c in _shuffled(list(letters), key))

    def changed(x: Column) -> Column:
        word, place = x["word"], x["place"]
        own = F.pmod(F.floor(attempt / F.pow(F.lit(64.0), place)), F.lit(64)).cast("int")
        new = (
            F.when(_is_family(word, place), _once(own, lambda a: _family(word, a, key)))
            .when(word.rlike(r"^(?:\p{Lu}\.)+$"), F.translate(word, capitals, exchanged))
            .otherwise(F.coalesce(F.get(_list(others), (F.array_position(_list(given), word) - 1).cast("int")), word))
        )
        return F.concat(new, x["rest"])

    def units(given_units: Column) -> Column:
        each = F.transform(given_units, lambda u, i: F.struct(F.regexp_extract(u, "^([^ ]+)", 1).alias("word"), F.regexp_extract(u, "^[^ ]+(.*)$", 1).alias("rest"), (F.size(given_units) - 1 - i).alias("place")))
        return F.array_join(F.transform(each, changed), " ")

    return F.concat(form, _once(_units(entity), units))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def surrogate(entity: Column, attempt: Column, key: str) -> Column:
    """Another entity of the same kind and format."""

    def seeded(x: Column) -> Column:
        # Every character hashes the seed, so a long entity is in it by its own hash.
        own = _once(canonical(x["kind"], x["entity"]), lambda c: F.when(F.length(c) > LONGEST_SEED, F.sha2(c.cast("binary"), 256)).otherwise(c))
        seed = F.concat_ws("|", F.lit(key), x["kind"], own, x["attempt"].cast("string"))
        return F.struct(x["entity"], x["attempt"], x["kind"], seed.alias("seed"), _value(x["entity"]).alias("value"))

    given = F.struct(entity.alias("entity"), attempt.alias("attempt"), kind_of(entity).alias("kind"))
    return _once(given, lambda x: _once(seeded(x), lambda y: _made(y["entity"], y["attempt"], y["kind"], y["seed"], y["value"], key)))


def _made(entity: Column, attempt: Column, kind: Column, seed: Column, value: Column, key: str) -> Column:
    country = F.length(F.regexp_replace(F.regexp_extract(entity, r"^(\+\d{1,3})(?=[ .-])", 1), "[^0-9]", ""))
    head = F.substring(entity, F.lit(1), F.length(entity) - F.length(value))
    hexed = _each(value, lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", _noise(seed, i))).otherwise(c))
    more = _added("abcdefghijklmnopqrstuvwxyz0123456789", seed, attempt)
    # A key of fixed length has enough characters, a phone number goes on in groups of four.
    longer = F.when(entity.rlike("^(?:AKIA|ASIA)"), F.lit("")).otherwise(more)
    groups = F.regexp_replace(_added("0123456789", seed, attempt), r"(\d{4})", "-$1")
    keyed = F.regexp_extract(entity, r"^(AKIA|ASIA|gh[pousr]_|sk-|xox[abpr]-)", 1)
    return (
        F.when(kind == "email", _email(entity, seed, attempt))
        .when(kind == "key", F.concat(keyed, _shaped(F.substring(entity, F.length(keyed) + 1, F.length(entity)), seed), longer))
        .when(kind == "setting", F.concat(head, F.when(value.rlike("^[0-9a-f]+$"), hexed).otherwise(_shaped(value, seed)), more))
        .when(kind == "address", _address(entity, seed, attempt))
        .when(kind == "card", _card(entity, seed))
        .when(kind == "account", F.concat(F.substring(entity, F.lit(1), F.lit(2)), _shaped(F.substring(entity, F.lit(3), F.length(entity)), seed)))
        .when(kind == "number", _digits(entity, seed, F.lit(0)))
        .when(kind == "phone", F.concat(_digits(entity, seed, country), groups))
        .when(kind == "name", _name(entity, attempt, key))
        .otherwise(hexed)
    )


def colliding_attempts(distinct: DataFrame, key: str, change=surrogate) -> DataFrame:
    """(kind, own, attempt): entities that need an attempt above 0.

    ``distinct`` has (kind, own, entity), one writing of each. Per attempt, of the entities
    that would share a surrogate the least keeps it, if nobody's surrogate or entity is the
    same; the others go on.
    """
    settled, todo = None, distinct.select("kind", "own", "entity")
    known = distinct.select("kind", F.col("own").alias("made"))
    for attempt in range(MOST_ATTEMPTS):
        tried = todo.withColumn("new", change(F.col("entity"), F.lit(attempt), key)).select("kind", "own", "entity", F.lit(attempt).alias("attempt"), canonical(F.col("kind"), F.col("new")).alias("made"))
        tried = stored(tried, "tried")
        first = tried.groupBy("kind", "made").agg(F.min("own").alias("winner"))
        taken = known if settled is None else known.unionByName(settled.select("kind", "made"))
        free = first.join(taken, ["kind", "made"], "left_anti")
        done = tried.join(free, ["kind", "made"]).where("own = winner").select("kind", "own", "entity", "attempt", "made")
        settled = stored(done if settled is None else settled.unionByName(done), "settled")
        todo = stored(tried.join(settled.select("kind", "own"), ["kind", "own"], "left_anti").select("kind", "own", "entity"), "colliding")
        if todo.isEmpty():
            return settled.where("attempt > 0").select("kind", "own", "attempt")
    raise RuntimeError("surrogates keep colliding: the numbers of a kind are used up")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, change=surrogate) -> DataFrame:
    """All rows and columns, each entity of the text replaced.

    A NULL text stays NULL; a text without entities stays as it is, byte by byte. ``count_col``
    adds how many were replaced. ``key`` is a secret: who has it can test guesses.
    """
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.where(text.rlike(TRACE)).select(text.alias("text")).select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.explode(F.array_distinct(entities(F.col("text")))).alias("entity"))
    found = own.withColumn("kind", kind_of(F.col("entity"))).withColumn("part", F.explode(parts_of(F.col("kind"), F.col("entity"))))
    found = stored(found.select("digest", "entity", "kind", F.col("part.own").alias("own"), F.col("part.place").alias("place"), F.col("part.entity").alias("writing")), "entities")
    distinct = stored(found.groupBy("kind", "own").agg(F.min("writing").alias("entity")), "distinct-entities")
    again = colliding_attempts(distinct, key, change)
    packed = F.sum(F.col("attempt") * F.pow(F.lit(64.0), F.col("place"))).cast("int").alias("attempt")
    affected = found.select("digest", "entity", "kind", "own", "place").distinct().join(again, ["kind", "own"]).groupBy("digest", "entity").agg(packed)
    affected = affected.groupBy("digest").agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias("__attempts"))
    affected = stored(affected.withColumnRenamed("digest", "__digest"), "affected")
    if affected.isEmpty():
        named = docs.withColumn("__attempts", F.lit(None).cast("map<string,int>"))
    else:
        named = docs.withColumn("__digest", F.sha2(text.cast("binary"), 256)).join(affected, "__digest", "left").drop("__digest")
    named = named.withColumn("__entities", entities(text))
    attempt = lambda e: F.coalesce(F.try_element_at(F.col("__attempts"), e), F.lit(0))
    made = F.transform("__entities", lambda e: change(e, attempt(e), key))
    pieces = F.split(text, ENTITY, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat(made, F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    new = F.when(F.size("__entities") > 0, joined).otherwise(text)
    columns = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    extra = [] if count_col is None else [F.coalesce(F.size("__entities"), F.lit(0)).alias(count_col)]
    return named.select(*columns, *extra)
