"""Personal data and secrets replaced by consistent surrogates.

One pattern finds mentions of e-mail addresses, phone and card numbers, IP addresses, access keys, values of passwords
and tokens (`key = "value"`, `key: value`), and names after a title. Mentions that mean the same entity (letter case,
spacing and punctuation aside) have one canonical form, and the canonical form, the kind and a secret key give its
surrogate: every mention of it, in any document, is replaced by the same one, written in the format of the mention. Surrogates are of the same kind: cards keep their network digit
and a valid check digit, names keep title, gender, script and number of words, numbers keep their separators.

Distinct entities stay distinct: surrogates of all entities of the corpus are checked against each other and against all
real entities, and losers of a collision (all but the smallest) draw again until none is left. Entities are aggregated
before any shuffle, and the tables that meet are written first, so Spark can split an entity that is in very many texts.

Null and empty texts have no mentions and stay as they are, as do all other columns. Equal texts are replaced once and
alike. The key is a parameter; surrogates cannot be mapped back without it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.text import query, rows_only, table, whole, with_row
from flowmarrow.session import frozen

KEY = "surrogates-1"
#: Texts with mentions whose replacements are sent to all executors at most, and bytes of these; more are joined by shuffle.
BROADCAST_TEXTS, BROADCAST_BYTES = 200_000, 2**26
MOST_ROUNDS = 60
#: Least characters of the surrogate of a secret.
LEAST_SECRET = 8

# Titles by gender and script, and given names to draw from.
TITLES = {
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme"],
    ("m", "latin"): ["Mr", "Herr", "Señor", "Monsieur"],
    ("n", "latin"): ["Dr", "Prof"],
    ("f", "cyrillic"): ["госпожа", "Госпожа", "г-жа"],
    ("m", "cyrillic"): ["господин", "Господин", "г-н"],
}
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Diana", "Elena", "Fiona", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nadia", "Paula", "Rosa", "Sarah", "Vera"],
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Louis", "Martin", "Oscar", "Peter", "Simon", "Victor"],
    ("n", "latin"): ["Alex", "Robin", "Kim", "Sascha", "Noel", "Dominique", "Andrea", "Chris", "Jordan", "Taylor", "Morgan", "Jamie", "Casey", "Quinn", "Rene", "Toni"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лариса", "Мария", "Нина", "Ольга", "Раиса", "Софья", "Тамара", "Юлия"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей"],
}
SYLLABLES = {
    "latin": ["ba", "do", "fe", "gri", "ha", "ken", "lo", "mar", "ne", "pol", "ri", "sta", "tu", "van", "wel", "zo"],
    "cyrillic": ["ба", "до", "фе", "гри", "ха", "кен", "ло", "мар", "не", "пол", "ри", "ста", "ту", "ван", "вел", "зо"],
}
_ALL_TITLES = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CARD, _PHONE = r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
#: What stands before the value of a secret; atomic, so that it ends at the same place in a text and in a mention.
_HOLDER = r"(?>(?=[AaPpSsTt])(?i:password|passwd|passphrase|pwd|(?:api|access|secret|private)[_-]?key|secret|token)\\?[\"']?[ \t]*(?::=|=>|==?|:(?!:))[ \t]*\\?[\"']?)"
_VALUE = r"(?:(?<=\")[^\"\\\r\n]+(?=\\?\")|(?<=')[^'\\\r\n]+(?=\\?')|[^\s\"']+)"
# inner capitals, apostrophes (but not the possessive s), hyphens, initials
_WORD = r"(?:\p{Lu}\.(?= \p{Lu})|\p{Lu}(?:\p{L}|\p{M}|['’](?!s(?!\p{L}))(?=\p{L})|-(?=\p{Lu}))++)"
_NAME = rf"(?:{_ALL_TITLES})\.? {_WORD}(?: (?!(?:{_ALL_TITLES})(?!\p{{L}})){_WORD})*+"
# groups repeat possessively, so that a mention of any length is read in a loop and not by recursion
#: (kind, pattern); the first that fits at a place wins.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?!\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("secret", _HOLDER + _VALUE),
    ("key", r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"),
    ("card", rf"(?<![\d.])(?<!\d-){_CARD}(?!-?\d)"),
    ("phone", rf"(?<![\d+]){_PHONE}(?!\d)"),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"),
    ("name", rf"(?<!\p{{L}}){_NAME}"),
]
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)


def kind_of(mention: Column) -> Column:
    """The kind of a mention without its holder, from its shape alone."""
    shapes = [
        ("email", r"^[^@\s]+@[^@\s]+\.[A-Za-z]+$"), ("key", r"^(AKIA|ASIA)[A-Z0-9]{16}$"), ("card", f"^{_CARD}$"), ("phone", f"^{_PHONE}$"),
        ("ip", rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), ("name", f"^{_NAME}$"),
    ]
    return reduce(lambda c, s: c.when(mention.rlike(s[1]), s[0]), shapes[1:], F.when(mention.rlike(shapes[0][1]), "email")).otherwise("secret")


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all mentions of an entity."""
    digits = F.regexp_replace(mention, r"\D", "")
    name = F.regexp_replace(mention, rf"^({_ALL_TITLES})\.? ", "")
    return (
        F.when(kind == "email", F.lower(mention)).when(kind == "card", digits).when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind == "name", F.concat(_trait(mention), F.lit("/"), F.initcap(name))).otherwise(mention)
    )


def _trait(mention: Column) -> Column:
    """Gender, script and number of words of a name with a title."""
    title = F.regexp_extract(mention, rf"^({_ALL_TITLES})\.? ", 1)
    chain = None
    for (gender, script), titles in TITLES.items():
        found = F.lit(f"{gender}/{script}")
        chain = F.when(title.isin(titles), found) if chain is None else chain.when(title.isin(titles), found)
    return F.concat(chain, F.lit("/"), (F.size(F.split(mention, " ")) - 1).cast("string"))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str = KEY) -> Column:
    """The canonical surrogate of a canonical entity, drawn from the key; another one for each attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string"))
    number = lambda salt: F.pmod(F.conv(F.substring(F.sha2(F.concat(seed, F.lit("\x1f"), salt if isinstance(salt, Column) else F.lit(salt)), 256), 1, 15), 16, 10).cast("long"), F.lit(10**15))
    text = F.sha2(seed, 256)
    letters = F.translate(text, "0123456789abcdef", "bcdfghklmnprstvz")
    local = F.concat(F.substring(letters, 1, 10), F.when(entity.rlike(r"\d.*@"), F.lpad((number("e") % 1000).cast("string"), 3, "0")).otherwise(""))
    email = F.concat(local, F.lit("@mail"), (number("d") % 1000).cast("string"), F.lit(".example."), F.regexp_extract(entity, r"\.([a-z]+)$", 1))
    fifteen = F.concat(F.substring(entity, 1, 1), F.lpad((number("c") % 10**14).cast("string"), 14, "0"))
    digit = lambda i: F.substring(fifteen, i, 1).cast("int")
    doubled = lambda i: F.when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    check = F.pmod(-reduce(lambda a, b: a + b, [doubled(i) if i % 2 else digit(i) for i in range(1, 16)]), F.lit(10))
    card = F.concat(fifteen, check.cast("string"))
    phone = F.concat(*[(200 + number(s) % 800).cast("string") for s in ("p", "q")], F.lpad((number("r") % 10_000).cast("string"), 4, "0"))
    ip = F.concat_ws(".", *[(1 + number(s) % 223).cast("string") for s in "ijkl"])
    access = F.concat(F.substring(entity, 1, 4), F.substring(F.upper(F.translate(text, "01", "yz")), 1, 16))
    # as long as the secret if that leaves enough to draw from, and longer with each attempt, so that one is free
    length = F.greatest(F.length(entity), F.lit(LEAST_SECRET)) + attempt
    secret = F.substring(F.repeat(text, F.ceil(length / 64).cast("int")), F.lit(1), length)
    name = None
    for trait, given in GIVEN.items():
        parts = SYLLABLES[trait[1]]
        pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (1 + number(salt) % len(values)).cast("int"))  # noqa: B023, E731
        surname = F.concat(F.initcap(pick(parts, "s")), *[pick(parts, f"s{i}") for i in range(4)])
        before = F.split_part(entity, F.lit("/"), F.lit(3)).try_cast("int") - 1
        draws = F.transform(F.sequence(F.lit(1), F.greatest(before, F.lit(1))), lambda i: pick(given, F.concat(F.lit("g"), i.cast("string"))))  # noqa: B023
        full = F.concat_ws(" ", F.when(before > 0, F.array_join(draws, " ")), surname)
        full = F.concat(F.regexp_extract(entity, "^([^/]*/[^/]*/[^/]*/)", 1), full)
        name = F.when(entity.startswith("/".join(trait) + "/"), full) if name is None else name.when(entity.startswith("/".join(trait) + "/"), full)
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip)
        .when(kind == "key", access).when(kind == "name", name).otherwise(secret)
    )


def rendered(kind: Column, mention: Column, drawn: Column) -> Column:
    """The surrogate in the format of a mention."""
    part = lambda p, i: F.regexp_extract(mention, p, i)
    card, phone = r"^\d{4}(\D?)\d{4}(\D?)\d{4}(\D?)\d{4}$", r"^(.*?)\d{3}(\D+)\d{3}(\D+)\d{4}$"
    cut = lambda a, n: F.substring(drawn, a, n)
    title = F.regexp_extract(mention, rf"^((?:{_ALL_TITLES})\.? )", 1)
    return (
        F.when(kind == "card", F.concat(cut(1, 4), part(card, 1), cut(5, 4), part(card, 2), cut(9, 4), part(card, 3), cut(13, 4)))
        .when(kind == "phone", F.concat(part(phone, 1), cut(1, 3), part(phone, 2), cut(4, 3), part(phone, 3), cut(7, 4)))
        .when(kind == "name", F.concat(title, F.regexp_extract(drawn, "^[^/]*/[^/]*/[^/]*/(.*)$", 1)))
        .otherwise(drawn)
    )


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, drawn): a surrogate for every distinct entity, equal to no other one and to no real entity."""
    real = frozen(entities.select("kind", "entity").distinct(), "entities")
    waiting, settled = real, None
    for attempt in range(MOST_ROUNDS):
        drawn = waiting.withColumn("drawn", surrogate(F.col("kind"), F.col("entity"), F.lit(attempt), key))
        taken = real.select("kind", F.col("entity").alias("drawn"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "drawn"))
        first = drawn.join(taken, ["kind", "drawn"], "left_anti").groupBy("kind", "drawn").agg(F.min("entity").alias("entity"))
        first = frozen(first.select("kind", "entity", "drawn"), "surrogates")
        settled = first if settled is None else settled.union(first)
        waiting = frozen(waiting.join(first, ["kind", "entity"], "left_anti"), "entities-waiting")
        if waiting.isEmpty():
            return settled
    raise ValueError("more entities of a kind than surrogates")


def mentions(docs: DataFrame) -> DataFrame:
    """(key, at, holder, mention, kind, entity): every mention in every distinct text, in order, and what names it if it is
    a secret; ``key`` is the text's digest."""
    t = whole(F.col("text"))
    m = docs.select(F.md5(t).alias("key"), F.posexplode(F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).alias("at", "mention"))
    holder = F.regexp_extract("mention", f"^{_HOLDER}", 0)
    m = m.select("key", "at", holder.alias("holder"), F.substring("mention", F.length(holder) + 1, F.length("mention")).alias("mention"))
    m = m.withColumn("kind", kind_of(F.col("mention")))
    return m.withColumn("entity", canonical(F.col("kind"), F.col("mention"))).distinct()


def _replacements(docs: DataFrame, key: str) -> DataFrame:
    found = frozen(mentions(docs), "mentions")
    drawn = frozen(assign(found, key), "surrogates")
    text = F.concat("holder", rendered(F.col("kind"), F.col("mention"), F.col("drawn")))
    put = found.join(drawn, ["kind", "entity"]).select("key", "at", text.alias("put"))
    put = put.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "put"))).alias("put"))
    return frozen(put.select(F.col("key").alias("put_key"), F.transform("put", lambda x: x["put"]).alias("put")), "replacements")


def _small(put: DataFrame) -> bool:
    """Whether replacements may go to all executors: a text can hold any number of them, so bytes are counted, not only rows."""
    parts = F.aggregate("put", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    found = put.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(parts + 64), F.lit(0)).alias("bytes")).first()
    return found["texts"] <= BROADCAST_TEXTS and found["bytes"] <= BROADCAST_BYTES


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with every mention replaced, with all their columns."""
    return rows_only(_replaced(docs, key).select("row"))


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    put = _replacements(docs.select("text"), key)
    if _small(put):
        put = F.broadcast(put)
    rows = with_row(docs, text=F.col("text"), key=F.md5(whole(F.col("text"))))
    rows = rows.join(put, rows.key == put.put_key, "left")
    between = F.split(whole(F.col("text")), ANY, -1)
    merged = F.array_join(F.flatten(F.zip_with(between, F.col("put"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    text = F.when(F.col("put").isNull(), F.col("text")).otherwise(merged)
    return rows.select(F.col("row").withField("text", text).alias("row"), F.coalesce(F.size("put"), F.lit(0)).alias("n"))


@query()
def op3_pii_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _replaced(docs, KEY).select("row.doc_id", F.col("n").cast("long").alias("n_replaced"), "row.text")
