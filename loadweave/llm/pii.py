"""Surrogates for personal data and secrets, in DataFrame functions only.

Detected entities are replaced by others of their kind: same letters-and-digits shape, issuer digit and
check sum of card numbers, country code of phones, top-level domain of addresses, prefix of keys, and for
names the gender that the title tells and the script. A surrogate is drawn from a keyed hash of the
entity, so an entity has the same one everywhere (words of a name each have their own, so a family name
keeps its surrogate with and without a given name). Draws that meet another entity's surrogate, or a real
entity, are drawn again until all differ; only those few go through a join, all others are an expression
of the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.session import materialise

# What an entity looks like. Java patterns, tried in this order.
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)",
    "phone": r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w])\d(?:[ -]?\d){12,18}(?!\w)",
    "key": r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)",
    "secret": r"(?i:password|passwd|secret|api_key|token)\s{0,2}[=:]\s{0,2}[\"']?[^\s\"']{6,}",
    "name": r"(?<!\p{L})(?:Mrs|Mr|Ms|Dr|Herr|Frau|Señora|Señor|Monsieur|Madame|Господин|Госпожа)\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?",
}
ANY = "|".join(KINDS.values())
SECRET_HEAD = r"^(?i:password|passwd|secret|api_key|token)\s{0,2}[=:]\s{0,2}[\"']?"
FEMALE = r"^(?:Mrs|Ms|Frau|Señora|Madame|Госпожа)"
MALE = r"^(?:Mr|Herr|Señor|Monsieur|Господин)\b"
# What invented names are made of, by script and role.
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ha he ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te".split(),
             "cyrillic": "ба бе би бо да де ди до ва ве га го ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те".split()}
ENDINGS = {"latin": {"female": "na lia rie sa".split(), "male": "no rt ton ls".split(), "any": "s n l m".split(),
                     "family": "son berg mann ford ler sen".split()},
           "cyrillic": {"female": "на лия рия са".split(), "male": "н рт лай с".split(), "any": "с н л м".split(),
                        "family": "ко вич мир дан".split()}}
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 50


def _kind(entity: Column) -> Column:
    return reduce(lambda rest, k: F.when(entity.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(rest), reversed(KINDS), F.lit("secret"))


def _hash(key: str, *parts: Column) -> Column:
    """512 keyed hexadecimal digits."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(f"{key}/{i}"), *parts), 256) for i in range(8)))


def _byte(drawn: Column, at: Column) -> Column:
    return F.conv(F.substring(drawn, F.pmod(at, F.lit(256)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, value: Column, n: Column | int) -> Column:
    return F.substring(F.lit(letters), F.pmod(value, F.lit(n) if isinstance(n, int) else n) + 1, F.lit(1))


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)."), 0)


def _shaped(text: Column, drawn: Column) -> Column:
    """Digits for digits (no zero for another), letters for letters of their case; hexadecimal stays so."""
    span = F.when(text.rlike("^[0-9a-fA-F]{16,}$"), 6).otherwise(26)

    def one(c: Column, i: Column) -> Column:
        v = _byte(drawn, i)
        return (F.when(c.rlike("[1-9]"), (F.pmod(v, F.lit(9)) + 1).cast("string")).when(c == "0", F.pmod(v, F.lit(10)).cast("string"))
                .when(c.rlike("[a-z]"), _pick(LOWER, v, span)).when(c.rlike("[A-Z]"), _pick(UPPER, v, span)).otherwise(c))

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column) -> Column:
    """The check sum of an array of digits, a check digit still to come."""
    n = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)),
                       F.lit(0), lambda a, b: a + b)


def _digits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]"), 0).cast("array<int>")


def _card(text: Column, drawn: Column) -> Column:
    body = F.concat(F.substring(text, 1, 1), _shaped(F.substring(text, F.lit(2), F.length(text) - 2), drawn))
    own = _digits(text)
    valid = F.pmod(_luhn(F.slice(own, F.lit(1), F.size(own) - 1)) + F.element_at(own, -1), F.lit(10)) == 0
    check = F.pmod(F.lit(10) - F.pmod(_luhn(_digits(body)), F.lit(10)), F.lit(10)).cast("string")
    last = F.when(valid, check).otherwise(_pick("0123456789", _byte(drawn, F.lit(255)), 10))
    return F.concat(body, last)


def _from(values: list[str], at: Column) -> Column:
    listed = F.array(*map(F.lit, values))
    return F.element_at(listed, F.pmod(at, F.lit(len(values))) + 1)


def _name(role: Column, word: Column, drawn: Column, attempt: Column) -> Column:
    """An invented word for a name's word: syllables and an ending, by script and role. There are three
    syllables, and one more every third attempt, so that there are places for any number of names."""
    more = F.slice(F.array(*map(F.lit, range(ROUNDS))), F.lit(1), F.floor(attempt / 3).cast("int"))

    def built(script: str) -> Column:
        parts = [_from(SYLLABLES[script], _byte(drawn, F.lit(i)) * 256 + _byte(drawn, F.lit(i + 8))) for i in range(3)]
        further = F.array_join(F.transform(more, lambda i: _from(SYLLABLES[script], _byte(drawn, i * 2 + 24) * 256 + _byte(drawn, i * 2 + 25))), "")
        ends = reduce(lambda rest, r: F.when(role == r, _from(ENDINGS[script][r], _byte(drawn, F.lit(20)))).otherwise(rest),
                      ENDINGS[script], F.lit(""))
        return F.initcap(F.concat(*parts, further, ends))

    return F.when(word.rlike(r"\p{IsCyrillic}"), built("cyrillic")).otherwise(built("latin"))


def _roles(entity: Column) -> tuple[Column, Column, Column]:
    """(title with its space, words, role of each word) of a name."""
    title = F.regexp_extract(entity, r"^\S+ ", 0)
    words = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    gender = F.when(entity.rlike(FEMALE), "female").when(entity.rlike(MALE), "male").otherwise("any")
    roles = F.when(F.size(words) > 1, F.array(gender, F.lit("family"))).otherwise(F.array(F.lit("family")))
    return title, words, roles


def units(entity: Column) -> Column:
    """What gets a surrogate of its own: the words of a name with their role, or else the entity."""
    kind = _kind(entity)
    _, words, roles = _roles(entity)
    of_name = F.transform(F.arrays_zip(words.alias("word"), roles.alias("role")),
                          lambda p: F.struct(p["role"].alias("kind"), p["word"].alias("value")))
    return F.when(kind == "name", of_name).otherwise(F.array(F.struct(kind.alias("kind"), entity.alias("value"))))


def draw(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a unit at an attempt."""
    drawn = _hash(key, kind, F.lower(value), attempt.cast("string"))
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    code = F.regexp_extract(value, r"^\+?\d{1,3}(?=[ .-]?\()|^\+\d{1,3}", 0)
    head = F.regexp_extract(value, SECRET_HEAD, 0)
    rest = lambda start: F.substring(value, F.length(start) + 1, F.length(value))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(_byte(drawn, i), F.lit(254)) + 1), ".")
    return (F.when(kind == "email", F.concat(_shaped(F.substring(value, F.lit(1), F.length(value) - F.length(top)), drawn), top))
            .when(kind == "ip", octets).when(kind == "phone", F.concat(code, _shaped(rest(code), drawn)))
            .when(kind == "card", _card(value, drawn)).when(kind == "key", F.concat(F.lit("AKIA"), _shaped(F.substring(value, 5, 16), drawn)))
            .when(kind == "secret", F.concat(head, _shaped(rest(head), drawn)))
            .when(kind.isin("female", "male", "any", "family"), _name(kind, value, drawn, attempt)).otherwise(_shaped(value, drawn)))


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt, surrogate) of the units whose first surrogate isn't theirs alone.

    ``found`` has distinct (kind, value). In a round each surrogate goes to the unit that had it before, or
    else to the smallest; the others, and those that drew a real value, draw again.
    """
    state = materialise(found.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw(F.col("kind"), F.col("value"), F.col("attempt"), key)), "drawn")
    for _ in range(ROUNDS):
        owner = state.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
        real = found.select(F.col("value").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        judged = state.join(owner, "surrogate", "left").join(real, "surrogate", "left")
        own = F.col("owner").isNull() | (F.struct("attempt", "kind", "value") == F.col("owner"))
        again = F.coalesce(F.col("real"), F.lit(False)) | ~own
        judged = materialise(judged.select("kind", "value", "attempt", "surrogate", again.alias("again")), "judged")
        if not judged.where("again").limit(1).count():
            return judged.where("attempt > 0").drop("again")
        attempt = F.col("attempt") + F.col("again").cast("int")
        fresh = F.when(F.col("again"), draw(F.col("kind"), F.col("value"), F.col("attempt") + 1, key)).otherwise(F.col("surrogate"))
        state = materialise(judged.select("kind", "value", fresh.alias("surrogate"), attempt.alias("attempt")), "drawn")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds: too many entities of one short form")


def replace(docs: DataFrame, secret: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, and ``n_entities``, the entities replaced.

    ``secret`` keys the draws. A null text stays null and an empty one empty, with no entities; repeated
    rows give repeated results; an existing column n_entities is replaced; columns named __found or
    __special are not kept.
    """
    entities = F.regexp_extract_all(F.col(text), F.lit(ANY), 0)
    rest = docs.drop("n_entities", "__found", "__special")
    # most texts have no digit, sign or title, and so no entity
    likely = F.col(text).rlike(r"[0-9@]|[=:]|Mr|Ms|Dr|Herr|Frau|Señor|Monsieur|Madame|Господин|Госпожа")
    scanned = rest.withColumn("__found", F.when(likely, entities))
    unit = F.explode(F.array_distinct(F.flatten(F.transform("__found", units)))).alias("unit")
    found = materialise(scanned.where(F.size("__found") > 0).select(unit).select("unit.*").distinct(), "entities")
    special = redrawn(found, secret)
    if special.limit(1).count():
        with_id = scanned.where(F.size("__found") > 0).select(F.col(key).alias("__id"), unit).select("__id", "unit.*").distinct()
        # the few that were drawn again, gathered by document
        listed = (with_id.join(special, ["kind", "value"]).groupBy("__id")
                  .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "value"), "surrogate"))).alias("__special")))
        scanned = scanned.join(listed, F.col(key).eqNullSafe(F.col("__id")), "left").drop("__id")
    else:
        scanned = scanned.withColumn("__special", F.lit(None).cast("map<string,string>"))

    def new(u: Column) -> Column:
        again = F.element_at("__special", F.concat_ws("\x1f", u["kind"], u["value"]))
        return F.coalesce(again, draw(u["kind"], u["value"], F.lit(0), secret))

    def swapped(entity: Column) -> Column:
        title = F.when(_kind(entity) == "name", _roles(entity)[0]).otherwise("")
        return F.concat(title, F.array_join(F.transform(units(entity), new), " "))

    n = F.greatest(F.coalesce(F.size("__found"), F.lit(0)), F.lit(0)).alias("n_entities")
    # between each piece and the next stands one surrogate
    ends = F.concat(F.transform("__found", swapped), F.array(F.lit("")))
    woven = F.array_join(F.zip_with(F.split(F.col(text), ANY, -1), ends, lambda piece, entity: F.concat(piece, entity)), "")
    rewritten = F.when(n > 0, woven).otherwise(F.col(text)).alias(text)
    return scanned.select(*(rewritten if c == text else F.col(c) for c in rest.columns), n)
