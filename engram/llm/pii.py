"""PII surrogates with DataFrame functions only.

Entities are found by one pattern, replaced by keyed surrogates of the same kind
and format, and put back into the text:

* e-mail: letters become letters, digits digits, the top-level domain stays;
* phone, card, social security and account numbers: digits change in place, a
  country code and a card's first digit stay, and a card number that passes the
  Luhn check still passes it;
* IP address: octets change, private ranges stay private;
* account numbers whose check digits are right get right ones again;
* names after a title (initials too), with a known given name, or of two parts after a cue
  such as "my name is": a given name of the same gender and script, a made-up family name
  of the same script, an initial of that.  A name that is found so in a document counts all over
  it: each of its words alone gets the same surrogate there.

Equal entities (compared without format: digits only, lower case) get equal
surrogates everywhere, so coreference survives.  Distinct entities get distinct
surrogates, and none that is itself an entity of the corpus (a given name may become
another one that occurs, never itself): the table of entities is checked after each
draw, and losers draw again until there are none.
Each draw gives family names one syllable more, every third one given name more;
after ``DRAWS`` draws, numbers get one more digit and addresses one more letter
a draw, and private ranges that are full go on in the next larger range.

Defined results: a null text stays null and an empty one empty; repeated rows
get equal texts; an empty table gives an empty result; other columns pass
through untouched in ``anonymise``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.session import cut

KEY = "engram"
#: Draws in the length of the entity, before each further draw is longer; and all draws.
DRAWS, LIMIT = 8, 48
#: Titles and the gender that they say.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Dr": "", "Prof": "", "Sir": "m", "Lady": "f", "Doctor": "", "Professor": ""}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): (
        "James John Robert Michael William David Thomas Daniel Peter Paul Hans Klaus Stefan Jürgen Pierre Jean Michel Luc Carlos José Juan Miguel Luis Pedro"
        " Noah Liam Oliver Henry Lucas Benjamin Matthew Andrew Joseph Charles Christopher Anthony Steven Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Nicholas Jonathan Stephen"
        " Alexander Markus Wolfgang Florian Tobias Matthias Sebastian François Philippe Antoine Julien Nicolas Thierry Diego Javier Antonio Manuel Fernando Pablo Sergio Rafael"
    ).split(),
    ("latin", "f"): (
        "Mary Anna Elizabeth Susan Sarah Karen Linda Emma Julia Laura Petra Ursula Heike Sabine Marie Claire Sophie Camille María Carmen Ana Lucía Elena Isabel"
        " Olivia Sophia Isabella Charlotte Amelia Emily Jessica Jennifer Patricia Barbara Margaret Lisa Nancy Betty Sandra Ashley Kimberly Donna Michelle Amanda Melissa Deborah Stephanie Rebecca Rachel"
        " Katharina Monika Birgit Stefanie Anja Nathalie Isabelle Hélène Chloé Manon Élodie Sofía Marta Paula Cristina Beatriz Teresa"
    ).split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Александр Владимир Павел Виктор".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Людмила Галина".split(),
}
#: Words before a name of two parts that need not be in any list.
CUES = ["name is ", "Name: ", "Dear ", "Signed, ", "signed by ", "Contact: ", "Patient: ", "Customer: ", "heiße ", "Sehr geehrte ", "Nom : ", "appelle ", "llamo ", "Nombre: ", "зовут ", "Имя: "]
#: Syllables that family names are made of, by script.
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo ra".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо ра".split(),
}
OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\\.){1,8}[A-Za-z]{2,24}",
    "ip": f"(?<![\\d.])(?:{OCTET}\\.){{3}}{OCTET}(?!\\d|\\.\\d)",
    "phone": "(?<![\\w+])(?:\\+\\d{1,3}[ .-]?)?\\(\\d{2,4}\\)[ .-]?\\d{3,4}[ .-]?\\d{3,4}(?!\\d)|(?<![\\w+])\\+\\d{1,3}(?:[ .-]?\\d{2,4}){2,4}(?!\\d)|(?<![\\w.-])\\d{3}[.-]\\d{3}[.-]\\d{4}(?![\\d-])",
    "ssn": "(?<![\\w-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])",
    "card": "(?<![\\w.])\\d(?:[ -]?\\d){12,18}(?!\\d)",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_TITLE = "|".join(TITLES)
#: A word of a name: O'Brien, Smith-Jones, Jean-Luc.
_PART = "\\p{Lu}(?:['’]\\p{Lu})?\\p{Ll}{1,30}(?:-\\p{Lu}?\\p{Ll}{1,30}|['’]\\p{Lu}\\p{Ll}{1,30}){0,2}"
_INITIAL = "\\p{Lu}\\."
_WORD = f"(?<![\\p{{L}}\\p{{N}}]){_PART}(?![\\p{{L}}])"
_CUED = f"(?<=(?:{'|'.join(CUES)})){_PART} {_PART}(?![\\p{{L}}])"
PATTERNS["name"] = f"(?<![\\p{{L}}])(?:(?:{_TITLE})\\.? (?:{_INITIAL} ){{0,3}}{_PART}(?:(?: {_INITIAL}){{0,2}} {_PART})?|(?:{_NAMES})(?: {_INITIAL}){{0,2}} {_PART})(?![\\p{{L}}])"
#: A look at the next characters, before a pattern is tried at all.
_CAPITALS = "".join(sorted({n[0] for n in [*TITLES, *_NAMES.split("|")]}))
AHEAD = {"email": "", "iban": "(?=[A-Z]{2}\\d)", "name": f"(?=[{_CAPITALS}])"}
PATTERN = "|".join([*(f"{AHEAD.get(k, '(?=[0-9(+])')}(?:{p})" for k, p in PATTERNS.items()), f"(?=\\p{{Lu}})(?:{_CUED})"])
#: A text without any of these holds no entity.
GATE = f"[@0-9]|(?=[{_CAPITALS}])(?:(?:{_TITLE})\\.? |(?:{_NAMES}) )|(?=[{''.join(sorted({c[0] for c in CUES}))}])(?:{'|'.join(CUES)})\\p{{Lu}}"
NUMBERS = ("phone", "ssn", "card", "iban")


def mentions(text: Column) -> Column:
    """Entities of a text in order, as they are spelled."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in ("iban", "card", "ssn", "phone", "ip", "email"):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _plain(mention: Column) -> Column:
    """A mention without its format."""
    return F.lower(F.regexp_replace(mention, "[ .()-]", ""))


def _script(word: Column) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def _given_kind(word: Column, title: Column) -> Column:
    """Gender of a given name: by the lists, or else by its title."""
    male, female = (sum((GIVEN[s, g] for s in SYLLABLES), []) for g in "mf")
    by_title = F.create_map(*[F.lit(x) for title, gender in TITLES.items() if gender for x in (title, gender)])
    return F.when(word.isin(male), F.lit("m")).when(word.isin(female), F.lit("f")).otherwise(F.coalesce(F.try_element_at(by_title, title), F.lit("f")))


def name_parts(mention: Column) -> Column:
    """(role, gender, word) of each word of a name: title, initial, given, and last the family name."""
    words = F.split(mention, " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), "\\.$", "")
    titled = title.isin(list(TITLES))
    return F.transform(
        words,
        lambda w, i: F.struct(
            F.when((i == 0) & titled, F.lit("title")).when(w.rlike(f"^{_INITIAL}$"), F.lit("initial")).when(i == F.size(words) - 1, F.lit("family")).otherwise(F.lit("given")).alias("role"),
            F.when(i == F.size(words) - 1, F.lit("")).otherwise(_given_kind(w, title)).alias("gender"),
            w.alias("word"),
        ),
    )


def _name_key(part: Column) -> Column:
    return F.concat_ws("|", part["role"], part["gender"], part["word"])


def keys_of(mention: Column) -> Column:
    """Entities that a mention names, as 'kind|canonical form'."""
    number = F.array(F.concat(kind_of(mention), F.lit("|"), _plain(mention)))
    address = F.array(F.concat(kind_of(mention), F.lit("|"), F.lower(mention)))
    names = F.transform(F.filter(name_parts(mention), lambda p: p["role"].isin("given", "family")), _name_key)
    kind = kind_of(mention)
    return F.when(kind == "name", names).when(kind.isin(*NUMBERS), number).otherwise(address)


def _byte(stream: Column, at: int | Column) -> Column:
    """A number from 0 to 255 out of a hexadecimal stream."""
    start = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(stream, start * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(words: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(number, F.lit(len(words))))


def _reshaped(value: Column, stream: Column, keep: Column) -> Column:
    """Letters for letters and digits for digits, from position ``keep`` on."""
    letters, digits = F.translate(stream, "0123456789abcdef", "bcdfghjklmnprstv"), F.translate(stream, "abcdef", "012345")

    def draw(c: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(128)) + 1
        return F.when(i < keep, c).when(c.rlike("[0-9]"), F.substring(digits, at, F.lit(1))).when(c.rlike("[a-z]"), F.substring(letters, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), draw), "")


def _remainder(iban: Column) -> Column:
    """An account number, first four characters last and letters as 10 to 35, modulo 97."""
    moved = F.split(F.upper(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))), "")
    worth = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(moved, F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + worth(c), F.lit(97)))


def draw(entity: Column, attempt: Column, key: str = KEY, draws: int = DRAWS) -> Column:
    """The surrogate of 'kind|canonical form' in a given draw."""
    kind, value = F.substring_index(entity, "|", 1), F.substring_index(entity, "|", -1)
    seed = F.concat(F.lit(key), F.lit("|"), entity, F.lit("|"), attempt.cast("string"))
    stream = F.concat(F.sha2(seed.cast("binary"), 256), F.sha2(F.concat(seed, F.lit("+")).cast("binary"), 256))
    more = F.greatest(attempt - (draws - 1), F.lit(0))
    digits, letters = (F.substring(F.translate(stream, "0123456789abcdef", to), F.lit(65), more) for to in ("0123456789012345", "bcdfghjklmnprstv"))
    tld = F.concat(F.lit("."), F.substring_index(value, ".", -1))
    email = F.concat(letters, _reshaped(F.substring(value, F.lit(1), F.length(value) - F.length(tld)), stream, F.lit(0)), tld)
    octets = [1 + F.pmod(_byte(stream, i), F.lit(254)) for i in range(4)]
    ip = (
        F.when((value.startswith("10.") & (attempt < 2 * draws)) | (value.startswith("192.168.") & attempt.between(draws, 2 * draws - 1)), F.concat_ws(".", F.lit("10"), *[o.cast("string") for o in octets[1:]]))
        .when(value.startswith("192.168.") & (attempt < draws), F.concat_ws(".", F.lit("192.168"), *[o.cast("string") for o in octets[2:]]))
        .otherwise(F.concat_ws(".", (11 + F.pmod(octets[0], F.lit(89))).cast("string"), *[o.cast("string") for o in octets[1:]]))
    )
    country = F.when(value.startswith("+"), F.greatest(F.length(value) - 10, F.lit(2))).otherwise(F.lit(0))
    phone = F.concat(_reshaped(value, stream, country), digits)
    body = F.concat(_reshaped(F.substring(value, F.lit(1), F.length(value) - 1), stream, F.lit(1)), digits)
    fits = F.get(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(body, d))), F.lit(0))
    card = F.when(F.call_function("luhn_check", value), F.concat(body, fits)).otherwise(F.concat(_reshaped(value, stream, F.lit(1)), digits))
    account = F.concat(_reshaped(F.substring(value, F.lit(5), F.length(value)), stream, F.lit(0)), digits)
    checked = F.lpad((98 - _remainder(F.concat(F.substring(value, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.when(_remainder(value) == 1, F.concat(F.substring(value, 1, 2), checked, account)).otherwise(F.concat(_reshaped(value, stream, F.lit(2)), digits))
    role, gender, word = F.get(F.split(entity, "\\|"), F.lit(0)), F.get(F.split(entity, "\\|"), F.lit(1)), value
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    for script in SYLLABLES:
        made = F.initcap(F.array_join(F.transform(F.sequence(F.lit(4), attempt + 6), lambda i: _pick(SYLLABLES[script], _byte(stream, i))), ""))  # noqa: B023
        family = F.when(_script(word) == script, made).otherwise(family)
        for g in "mf":
            name = F.array_join(F.transform(F.sequence(F.lit(1), (attempt / 3).cast("int") + 1), lambda i: _pick(GIVEN[script, g], _byte(stream, i))), "-")  # noqa: B023
            given = F.when((_script(word) == script) & (gender == g), name).otherwise(given)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
        .when(kind == "ssn", F.concat(_reshaped(value, stream, F.lit(0)), digits)).when(kind == "iban", iban).when(role == "given", given).otherwise(family)
    )


def surrogates(entities: DataFrame, key: str = KEY, draws: int = DRAWS) -> DataFrame:
    """(entity, surrogate) for the distinct column ``entity``; no two entities
    of a kind share a surrogate, and no surrogate is an entity of the kind."""
    kind = F.substring_index("entity", "|", 1)
    own = F.substring_index("entity", "|", -1)
    pending = cut(entities.select("entity").distinct().select("entity", F.lit(0).alias("attempt")))
    real = pending.select(kind.alias("kind"), F.lower(own).alias("same"), F.lit(True).alias("real"))
    won: list[DataFrame] = []
    rank = Window.partitionBy("kind", "same").orderBy("entity")
    for _ in range(LIMIT):
        drawn = cut(pending.withColumn("kind", kind).withColumn("surrogate", draw(F.col("entity"), F.col("attempt"), key, draws)).withColumn("same", F.lower("surrogate")))
        # Who has lost draws again; who has won keeps its surrogate, which later draws can't take.
        taken = [real, *(w.select("kind", "same", F.lit(False).alias("real")) for w in won)]
        met = reduce(DataFrame.unionByName, taken).join(drawn.select("kind", "same").distinct(), ["kind", "same"], "left_semi").groupBy("kind", "same").agg(F.max("real").alias("real"), F.min("real").alias("both"))
        ranked = drawn.join(met, ["kind", "same"], "left").withColumn("rank", F.row_number().over(rank))
        # A known given name may stand for another person of that name: only equal draws, and the name itself, collide there.
        given = F.coalesce("real", F.lit(False)) & ((F.col("kind") != "given") | (F.col("same") == F.lower(own)))
        lost = (F.col("rank") > 1) | given | ~F.coalesce("both", F.lit(True))
        now = cut(ranked.select("entity", "attempt", "surrogate", "kind", "same", lost.alias("lost")))
        won.append(now.filter("not lost").select("entity", "surrogate", "kind", "same"))
        pending = now.filter("lost").select("entity", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, won).select("entity", "surrogate")
    raise ValueError(f"entities without a surrogate of their own after {LIMIT} draws")


def _filled(mention: Column, digits: Column) -> Column:
    """The characters of ``digits`` in the format of ``mention``, what it has no place for at the end."""
    places = F.split(mention, "")
    before = lambda i: F.size(F.filter(F.slice(places, F.lit(1), i), lambda c: ~c.rlike("[ .()-]")))
    inside = F.array_join(F.transform(places, lambda c, i: F.when(c.rlike("[ .()-]"), c).otherwise(F.substring(F.upper(digits), before(i) + 1, F.lit(1)))), "")
    return F.concat(inside, F.substring(F.upper(digits), F.length(_plain(mention)) + 1, F.length(digits)))


def _rendered(mention: Column, table: Column) -> Column:
    kind = kind_of(mention)
    number = _filled(mention, F.try_element_at(table, F.concat(kind, F.lit("|"), _plain(mention))))
    address = F.try_element_at(table, F.concat(kind, F.lit("|"), F.lower(mention)))
    parts = name_parts(mention)
    family = F.try_element_at(table, _name_key(F.element_at(parts, -1)))
    initial = lambda p: F.concat(F.when(F.substring(family, 1, 1) == F.substring(p["word"], 1, 1), F.upper(F.substring(family, 2, 1))).otherwise(F.substring(family, 1, 1)), F.lit("."))
    names = F.array_join(F.transform(parts, lambda p: F.coalesce(F.when(p["role"] == "initial", initial(p)).otherwise(F.try_element_at(table, _name_key(p))), p["word"])), " ")
    return F.coalesce(F.when(kind == "name", names).when(kind.isin(*NUMBERS), number).otherwise(address), mention)


def _alone(piece: Column, table: Column) -> Column:
    """A piece of text between mentions, words of the document's names replaced."""
    found, rest = F.regexp_extract_all(piece, F.lit(_WORD), F.lit(0)), F.split(piece, _WORD, -1)
    known = lambda w: F.coalesce(*[F.try_element_at(table, F.concat(F.lit(k), w)) for k in ("family||", "given|m|", "given|f|")], w)
    return F.concat(F.array_join(F.transform(found, lambda w, i: F.concat(F.get(rest, i), known(w))), ""), F.get(rest, F.size(found)))


def anonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, plus the number of entities as
    ``n_entities`` (with underscores more where ``docs`` has a column of that name)."""
    count = "n_entities"
    while count in docs.columns:
        count += "_"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("body"))
    has_some = F.coalesce(F.col("body").rlike(GATE) & F.col("body").rlike(PATTERN), F.lit(False))
    plain = rows.filter(~has_some)
    # Only the rows that hold entities are kept between the steps.
    hit = cut(rows.filter(has_some).withColumn("found", mentions(F.col("body"))).withColumn("keys", F.array_sort(F.array_distinct(F.flatten(F.transform("found", keys_of))))))
    hit = hit.withColumn("list", F.sha2(F.array_join("keys", "\n").cast("binary"), 256))
    # A row's own table of entities is keyed by what it holds, not by the row.
    lists = hit.select("list", "keys").dropDuplicates(["list"])
    table = surrogates(lists.select(F.explode("keys").alias("entity")), key)
    tables = lists.select("list", F.explode("keys").alias("entity")).join(table, "entity").groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("table"))
    keyed = hit.join(tables, "list")
    words = F.transform(F.filter("keys", lambda k: k.startswith("family|") | k.startswith("given|")), lambda k: F.substring_index(k, "|", -1))
    again = lambda p: F.exists("words", lambda w: F.contains(p, w))  # noqa: E731  few pieces hold a name's word once more
    keyed = keyed.withColumn("words", words)
    keyed = keyed.withColumn("pieces", F.transform(F.split("body", PATTERN, -1), lambda p: F.when(again(p), _alone(p, F.col("table"))).otherwise(p)))
    pieces = F.col("pieces")
    new = F.concat(F.array_join(F.transform("found", lambda m, i: F.concat(F.get(pieces, i), _rendered(m, F.col("table")))), ""), F.get(pieces, F.size("found")))
    done = keyed.select("row", new.alias("body"), F.size("found").cast("long").alias("n")).unionByName(plain.select("row", "body", F.lit(0).cast("long").alias("n")))
    return done.select(*[F.col("body").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("n").alias(count))


def private_texts(docs: DataFrame) -> DataFrame:
    """The result that query op4 returns: every document with surrogates in place."""
    return anonymise(docs.select("doc_id", "text"))
