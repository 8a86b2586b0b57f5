"""Surrogates for personal data, in built-in expressions only.

Entities are found by patterns and replaced by made-up ones of the same type: digits stay digits,
letters letters, capitals capitals; a card number that passes the Luhn test still does; an address of
a private network stays in it; a name keeps its title, its gender and its script. A surrogate is a
keyed hash of the entity, so the same entity has the same surrogate everywhere (in small or capital
letters), and nobody without the key can tell the way back. A name is replaced word by word: "Mr.
Smith" and "Mr. John Smith" go on sharing a surname.

Two entities must not get one surrogate, nor may a surrogate be a real entity of the corpus. Both are
checked over all distinct entities; those that clash get a further attempt, until none is left. Only
these exceptions are joined back to the texts that hold them; all other surrogates are computed in
the row. From the third attempt on a surrogate grows longer, so that small spaces never run out.

Defined results: a null text stays null, an empty one empty; texts without entities do not change;
equal rows get equal results; an empty table gives no rows; all columns of the input stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floeline.llm.quality import let
from floeline.sources import scratch

# fixed values: patterns of entities, titles and the syllables of made-up names
EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
ADDRESS = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
PHONE = r"(?<!\d)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)"
NUMBER = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ACCOUNT = r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,128}|(?:sk|pk|ghp|AKIA)[-_]?[0-9A-Za-z]{16,})(?![0-9A-Za-z])"
MALE = "Mr|Herr|Señor|Monsieur|Sir|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Госпожа|Κυρία"
EITHER = "Dr|Prof|Доктор"
PERSON = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{EITHER})\.?[  ]\p{{Lu}}\p{{L}}+(?:[  ]\p{{Lu}}\p{{L}}+)?"
SYLLABLES = {
    "latin": ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va"],
    "cyrillic": ["ба", "ве", "ди", "го", "ду", "жа", "зе", "ки", "ло", "му", "на", "пе", "ри", "со", "ту", "фа"],
    "greek": ["βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "ξυ", "πα", "ρε", "σι", "το", "φυ", "χα"],
}
ENDINGS = {
    "latin": {"male": "n", "female": "ra", "either": "l", "surname": "ter"},
    "cyrillic": {"male": "н", "female": "ра", "either": "ль", "surname": "тов"},
    "greek": {"male": "ς", "female": "ρα", "either": "λ", "surname": "δης"},
}

ANY = "|".join([EMAIL, SECRET, ADDRESS, CARD, PHONE, NUMBER, ACCOUNT, PERSON])
#: No entity is without one of these.
QUICK = rf"[0-9]{{3}}|@|\.[0-9]|\+[0-9]|[A-Z]{{2}}[0-9]{{2}}|(?:{MALE}|{FEMALE}|{EITHER})\.?[  ]|(?:sk|pk|ghp|AKIA)[-_]?[0-9A-Za-z]{{16}}|[0-9a-fA-F]{{32}}"

GROWS = 3


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind(value: Column) -> Column:
    """Type of an entity that ANY found."""
    tests = [("email", EMAIL), ("secret", SECRET), ("address", ADDRESS), ("card", CARD), ("phone", PHONE), ("number", NUMBER), ("account", ACCOUNT)]
    found = F.when(value.contains("@"), F.lit("email"))
    for name, pattern in tests[1:]:
        found = found.when(value.rlike(whole(pattern)), F.lit(name))
    return found.otherwise(F.lit("person"))


def _byte(hashed: Column, at: Column) -> Column:
    return F.conv(F.substring(hashed, F.pmod(at * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")


def _keyed(key: str, name, value: Column, attempt: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.sha2(F.concat_ws("\u0001", F.lit(key), name, F.lower(value), attempt.cast("string")), 256)


def fill(value: Column, hashed: Column, hexadecimal: bool = False) -> Column:
    """`value` with each letter and digit replaced by one of its class."""

    def one(i: Column) -> Column:
        c, n = F.substring(value, i, F.lit(1)), _byte(hashed, i)
        if hexadecimal:
            low = F.substring(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1))
            return F.when(c.rlike("[A-F]"), F.upper(low)).when(c.rlike("[0-9a-f]"), low).otherwise(c)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))
        digit = (n % 10).cast("string")
        return F.when(c.rlike(r"\d"), digit).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    made = F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")
    return F.when(F.length(value) > 0, made).otherwise(F.lit(""))


def _longer(attempt: Column) -> Column:
    """What is added to a surrogate whose space may be exhausted."""
    return F.when(attempt >= GROWS, attempt.cast("string")).otherwise(F.lit(""))


def _email(value: Column, key: str, attempt: Column) -> Column:
    local, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(-1))
    label = F.split_part(domain, F.lit("."), F.lit(1))
    tail = F.when(domain.rlike("[a-z]"), F.lit(".example.net")).otherwise(F.lit(".EXAMPLE.NET"))
    first = let(_keyed(key, "email", value, attempt), lambda h: fill(local, h))
    second = let(_keyed(key, "domain", domain, F.lit(0)), lambda h: fill(label, h))
    return F.concat(first, _longer(attempt), F.lit("@"), second, tail)


def _address(value: Column, key: str, attempt: Column) -> Column:
    hashed = _keyed(key, "address", value, attempt)

    def made(h: Column) -> Column:
        # from the third attempt on the fields come from further parts of the hash, the format has no longer form
        parts = [(_byte(h, F.lit(i)) % 254 + 1).cast("string") for i in range(1, 5)]
        private = F.when(value.startswith("10."), F.lit("10.")).when(value.startswith("192.168."), F.lit("192.168."))
        kept = F.coalesce(private, F.lit(""))
        rest = F.when(kept == "10.", F.concat_ws(".", *parts[1:])).when(kept == "192.168.", F.concat_ws(".", *parts[2:]))
        return F.concat(kept, F.coalesce(rest, F.concat_ws(".", *parts)))

    return let(hashed, made)


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn test over a string of digits, the last counting once."""

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed), F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str, attempt: Column) -> Column:
    raw = let(_keyed(key, "card", F.regexp_replace(value, "[ -]", ""), attempt), lambda h: fill(value, h))
    kept_first = F.concat(F.substring(value, F.lit(1), F.lit(1)), F.substring(raw, F.lit(2), F.length(value)))

    def checked(made: Column) -> Column:
        body = F.substring(made, F.lit(1), F.length(made) - 1)
        last = F.pmod(10 - _luhn(F.concat(F.regexp_replace(body, "[ -]", ""), F.lit("0"))) % 10, F.lit(10))
        valid = _luhn(F.regexp_replace(value, "[ -]", "")) % 10 == 0
        return F.when(valid, F.concat(body, last.cast("string"))).otherwise(made)

    return let(kept_first, checked)


def _phone(value: Column, key: str, attempt: Column) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(value, F.length(country) + 1, F.length(value))
    return F.concat(country, let(_keyed(key, "phone", F.regexp_replace(value, r"[^\d+]", ""), attempt), lambda h: fill(rest, h)))


def _shaped(name: str, hexadecimal: bool = False):
    def made(value: Column, key: str, attempt: Column) -> Column:
        return let(_keyed(key, name, value, attempt), lambda h: fill(value, h, hexadecimal))

    return made


def _secret(value: Column, key: str, attempt: Column) -> Column:
    plain = value.rlike("^[0-9a-fA-F]+$")
    return F.when(plain, _shaped("secret", True)(value, key, attempt)).otherwise(_shaped("secret")(value, key, attempt))


def _name(part: str):
    """A word of a name: syllables of its script and an ending of its gender."""

    def made(value: Column, key: str, attempt: Column) -> Column:
        def built(script: str):
            def syllables(h: Column) -> Column:
                known = F.array(*[F.lit(s) for s in SYLLABLES[script]])
                count = F.when(attempt >= GROWS, attempt).otherwise(F.lit(2))
                picked = F.transform(F.sequence(F.lit(1), count), lambda i: F.get(known, _byte(h, i) % len(SYLLABLES[script])))
                return F.initcap(F.concat(F.array_join(picked, ""), F.lit(ENDINGS[script][part])))

            return let(_keyed(key, part, value, attempt), syllables)

        word = (
            F.when(value.rlike(r"\p{IsCyrillic}"), built("cyrillic"))
            .when(value.rlike(r"\p{IsGreek}"), built("greek"))
            .otherwise(built("latin"))
        )
        return F.when(value.rlike(r"\p{Ll}"), word).otherwise(F.upper(word))

    return made


MAKERS = {
    "email": _email, "address": _address, "card": _card, "phone": _phone, "number": _shaped("number"),
    "account": _shaped("account"), "secret": _secret, "male": _name("male"), "female": _name("female"),
    "either": _name("either"), "surname": _name("surname"),
}


def surrogate(name: Column, value: Column, key: str, attempt: Column) -> Column:
    made = reduce(lambda c, item: c.when(name == item[0], item[1](value, key, attempt)), MAKERS.items(), F.when(F.lit(False), F.lit("")))
    return made.otherwise(value)


def _title(value: Column) -> Column:
    return F.regexp_extract(value, r"^\p{L}+\.?[  ]", 0)


def _gender(value: Column) -> Column:
    male, female = value.rlike(rf"^(?:{MALE})\.?[  ]"), value.rlike(rf"^(?:{FEMALE})\.?[  ]")
    return F.when(male, F.lit("male")).when(female, F.lit("female")).otherwise(F.lit("either"))


def parts(value: Column) -> Column:
    """What is replaced in an entity: itself, or the words of a name, the last of them a surname."""

    def of(name: Column) -> Column:
        names = F.split(F.substring(value, F.length(_title(value)) + 1, F.length(value)), r"[  ]")
        words = F.transform(
            names,
            lambda w, i: F.struct(F.when(i == F.size(names) - 1, F.lit("surname")).otherwise(_gender(value)).alias("kind"), w.alias("value")),
        )
        return F.when(name == "person", words).otherwise(F.array(F.struct(name.alias("kind"), value.alias("value"))))

    return let(kind(value), of)


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def canonical(name: Column, value: Column) -> Column:
    """Two spellings of one entity agree in this."""
    return F.when(name.isin("card", "phone"), F.regexp_replace(value, r"[^\d+]", "")).otherwise(F.lower(value))


def distinct_parts(docs: DataFrame, text: str) -> DataFrame:
    """(kind, id, value): each distinct entity of the corpus, with one of its spellings."""
    found = docs.where(F.col(text).rlike(QUICK)).select(F.explode(entities(F.col(text))).alias("_entity"))
    split = found.select(F.inline(parts(F.col("_entity"))))
    return split.groupBy("kind", canonical(F.col("kind"), F.col("value")).alias("id")).agg(F.min("value").alias("value"))


def exceptions(known: DataFrame, key: str) -> DataFrame:
    """(kind, id, attempt) of the entities whose first surrogate clashes with another one or with an entity."""
    state = known.withColumn("attempt", F.lit(0))
    while True:
        made = surrogate(F.col("kind"), F.col("value"), key, F.col("attempt"))
        tried = scratch.stage(state.withColumn("made", canonical(F.col("kind"), made)), "surrogates")
        same = tried.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("attempt"), "id")).alias("first"))
        real = tried.select("kind", F.col("id").alias("made"), F.lit(True).alias("real"))
        twins = same.where("n > 1").select("kind", "made", F.col("first.id").alias("owner"))
        checked = tried.join(twins, ["kind", "made"], "left").join(real, ["kind", "made"], "left")
        clash = F.coalesce(F.col("real"), F.lit(False)) | (F.col("owner").isNotNull() & (F.col("owner") != F.col("id")))
        judged = scratch.stage(checked.select("kind", "id", "value", "attempt", clash.alias("clash")), "judged")
        if judged.where("clash").isEmpty():
            return judged.where("attempt > 0").select("kind", "id", "attempt")
        state = judged.select("kind", "id", "value", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def rewritten(text: Column, key: str, attempts: Column | None = None) -> Column:
    """`text` with surrogates; `attempts` is an array of (kind, id, attempt) for entities that clash."""

    def attempt_of(name: Column, value: Column) -> Column:
        if attempts is None:
            return F.lit(0)
        own = F.filter(attempts, lambda a: (a["kind"] == name) & (a["id"] == canonical(name, value)))
        return F.coalesce(F.get(own, F.lit(0))["attempt"], F.lit(0))

    def new_part(part: Column) -> Column:
        return let(attempt_of(part["kind"], part["value"]), lambda n: surrogate(part["kind"], part["value"], key, n))

    def new(value: Column) -> Column:
        made = let(parts(value), lambda p: F.array_join(F.transform(p, new_part), " "))
        title = F.when(value.rlike(whole(PERSON)), _title(value)).otherwise(F.lit(""))
        return F.concat(title, made)

    def woven(found: Column) -> Column:
        between = F.split(text, ANY, -1)
        return F.array_join(F.zip_with(between, F.transform(found, new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.when(text.rlike(QUICK), let(entities(text), lambda found: F.when(F.size(found) > 0, woven(found)).otherwise(text))).otherwise(text)


def with_surrogates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with the column `text` rewritten."""
    known = scratch.stage(distinct_parts(docs, text), "entities")
    odd = exceptions(known, key)
    body = F.col(text)
    if odd.isEmpty():
        return docs.withColumn(text, rewritten(body, key))
    # texts that hold an exception are found by a join over the entities, and only they need the list
    held = docs.where(body.rlike(QUICK)).select(F.xxhash64(body).alias("_text"), F.explode(entities(body)).alias("_entity"))
    split = held.select("_text", F.inline(parts(F.col("_entity")))).withColumn("id", canonical(F.col("kind"), F.col("value")))
    lists = (
        split.join(odd, ["kind", "id"])
        .groupBy("_text")
        .agg(F.collect_set(F.struct("kind", "id", "attempt")).alias("_attempts"))
    )
    joined = docs.join(lists, F.xxhash64(body) == F.col("_text"), "left")
    simple = rewritten(body, key)
    listed = rewritten(body, key, F.col("_attempts"))
    return joined.withColumn(text, F.when(F.col("_attempts").isNull(), simple).otherwise(listed)).select(*docs.columns)
