"""Surrogates for personal data: keyed replacements of the same kind and format, the same for the same entity and different for different ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, text_key

#: The session setting that has the secret key of the surrogates; without it (tests) this one is used, which anyone can read here.
KEY_SETTING, TEST_KEY = "spark.facetframe.surrogates.key", "facetframe-surrogates"
#: From this attempt on, surrogates get longer by one place with each attempt (IP addresses get wider octets), as those of the mention's own length may be used up.
GROW = 3

#: Titles by gender; syllables and endings that surrogate names are built from, by script and gender.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")}
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "we", "zi", "lu"), "cyrillic": ("ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "си", "то", "ва", "ве", "зи", "лу")}
ENDINGS = {("latin", "m"): ("ron", "vin", "mas", "lo"), ("latin", "f"): ("ra", "lia", "nne", "lla"), ("latin", "s"): ("ner", "son", "rez", "lin"), ("cyrillic", "m"): ("рон", "вин", "мас", "лав"), ("cyrillic", "f"): ("ра", "лия", "нна", "лла"), ("cyrillic", "s"): ("ко", "нюк", "ян", "дзе")}

_TITLE = "|".join(sorted((t for some in TITLES.values() for t in some), key=lambda t: (-len(t), t)))
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity.
HINT = rf"[0-9@]|[a-f]{{32}}|[A-F]{{32}}|AKIA[A-Z]|gh[pousr]_[A-Za-z]|(?:{_TITLE})\.? \p{{Lu}}"


def _kind(mention: Column) -> Column:
    out = F.lit("person")
    for kind, p in reversed(list(PATTERNS.items())[:-1]):
        whole = "^(?:" + p.replace(r"(?<![A-Za-z0-9._%+-])", "") + ")$"
        out = F.when(mention.rlike(whole), F.lit(kind)).otherwise(out)
    return out


def _norm(kind: Column, mention: Column) -> Column:
    """What mentions of the same entity have in common: case of emails, punctuation of numbers and titles of persons don't count."""
    digits, plain = F.regexp_replace(mention, "[^0-9]", ""), F.regexp_replace(mention, "[^A-Za-z0-9]", "")
    return (
        F.when(kind == "email", F.lower(mention)).when(kind.isin("phone", "ssn", "card"), digits).when(kind == "ip", mention)
        .when(kind.isin("secret", "iban"), F.lower(plain)).otherwise(F.regexp_replace(mention, rf"^(?:{_TITLE})\.? ", ""))
    )


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hex digits from key, kind, entity and attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(F.sha2(seed.cast("binary"), 256), F.sha2(F.concat(F.lit("+"), seed).cast("binary"), 256))


def _number(stream: Column, at: Column) -> Column:
    """A number of 0 to 65535 from place `at` (from 0) of a stream."""
    return F.conv(F.substr(stream, F.pmod(at * 4, F.lit(124)).cast("int") + 1, F.lit(4)), 16, 10).cast("int")


def _spelled(mention: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Letters and digits of a mention replaced one by one, by case; all else stays. The n-th letter or digit depends on n alone."""
    def letter(n: Column, first: str) -> Column:
        return F.chr(F.lit(ord(first)) + n % (6 if hexadecimal else 26))

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), r"[^A-Za-z0-9]", "")))
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), letter(n, "a")).when(c.rlike("[A-Z]"), letter(n, "A")).otherwise(c)

    return F.array_join(F.transform(F.split(mention, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum by Luhn of a string of digits; a valid number has one that 10 divides."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _extra(attempt: Column) -> Column:
    """How many places a surrogate is longer than its mention."""
    return F.greatest(attempt - (GROW - 1), F.lit(0))


def _card(mention: Column, stream: Column, attempt: Column) -> Column:
    """Digits replaced; the last one makes the number valid by Luhn just where the mention is."""
    spelled, was = _spelled(F.concat(F.repeat(F.lit("0"), _extra(attempt)), mention), stream), _luhn(F.regexp_replace(mention, "[^0-9]", "")) % 10
    head = F.substr(spelled, F.lit(1), F.length(spelled) - 1)
    check = F.pmod(was - _luhn(F.concat(F.regexp_replace(head, "[^0-9]", ""), F.lit("0"))), F.lit(10))
    return F.concat(head, check.cast("string"))


def _ip(mention: Column, stream: Column, attempt: Column) -> Column:
    def octet(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        return F.when(attempt >= GROW + 4, 100 + n % 900).when((attempt >= GROW) | (F.length(c) == 3), 100 + n % 156).when(F.length(c) == 2, 10 + n % 90).otherwise(1 + n % 9).cast("string")

    return F.array_join(F.transform(F.split(mention, r"\."), octet), ".")


def _name(part: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    """A made-up name for one name, of its script and kind (surname, or given name by gender)."""
    def built(script: str) -> Column:
        of = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        end = lambda g: F.element_at(F.array(*[F.lit(x) for x in ENDINGS[script, g]]), _number(stream, F.lit(9)) % 4 + 1)
        syllable = lambda i: F.element_at(of, _number(stream, i) % 16 + 1)
        more = F.when(_extra(attempt) > 0, F.array_join(F.transform(F.sequence(F.lit(10), 9 + _extra(attempt)), syllable), "")).otherwise("")
        return F.concat(F.initcap(F.concat(*[syllable(F.lit(i)) for i in range(3)])), more, F.when(kind == "given_f", end("f")).when(kind == "given_m", end("m")).otherwise(end("s")))

    return F.when(part.rlike(r"\p{IsCyrillic}"), built("cyrillic")).otherwise(built("latin"))


def _email(key: str, mention: Column, stream: Column, attempt: Column) -> Column:
    """The name and the domain's own labels are spelled anew, the domain alike in all addresses of it; its last labels stay."""
    domain = F.substring_index(mention, "@", -1)
    tail = F.regexp_extract(domain, r"^[^.]+((?:\.[^.]+)+)$", 1)
    tail = F.when(F.size(F.split(domain, r"\.")) > 2, F.concat(F.lit("."), F.substring_index(domain, ".", -2))).otherwise(tail)
    own = F.substr(domain, F.lit(1), F.length(domain) - F.length(tail))
    spelled = _spelled(own, _stream(key, F.lit("domain"), F.lower(domain), attempt))
    name = F.concat(F.substring_index(mention, "@", 1), F.repeat(F.lit("a"), _extra(attempt)))
    return F.concat(_spelled(name, stream), F.lit("@"), spelled, tail)


def surrogate(key: str, kind: Column, mention: Column, stream: Column, attempt: Column) -> Column:
    """Of one entity; a person's names are entities of their own."""
    code = F.regexp_extract(mention, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    after = lambda at: F.concat(F.substr(mention, at), F.repeat(F.lit("0"), _extra(attempt)))  # noqa: E731  digits that the mention does not have, to be spelled
    return (
        F.when(kind == "email", _email(key, mention, stream, attempt)).when(kind == "secret", F.when(mention.rlike("^(?:AKIA|gh[pousr]_)"), F.concat(F.substr(mention, F.lit(1), F.lit(4)), _spelled(after(F.lit(5)), stream))).otherwise(_spelled(after(F.lit(1)), stream, True)))
        .when(kind == "phone", F.concat(code, _spelled(after(F.length(code) + 1), stream))).when(kind == "ip", _ip(mention, stream, attempt))
        .when(kind == "card", _card(mention, stream, attempt)).when(kind == "iban", F.concat(F.substr(mention, F.lit(1), F.lit(2)), _spelled(after(F.lit(3)), stream)))
        .when(kind == "ssn", _spelled(after(F.lit(1)), stream)).otherwise(_name(mention, kind, stream, attempt))
    )


def _parts(kind: Column, mention: Column) -> Column:
    """The entities of a mention as structs (kind, norm, mention). A person's are the last name and, if there is one, the first name by the title's gender, so 'Mr Smith' and 'Mr John Smith' agree."""
    part = lambda k, norm, m: F.struct(k.alias("kind"), norm.alias("norm"), m.alias("mention"))
    title = F.regexp_extract(mention, rf"^(?:{_TITLE})\.? ", 0)
    names = F.split(F.substr(mention, F.length(title) + 1), " ")
    last, first = F.element_at(names, -1), F.element_at(names, 1)
    given = F.when(title.rlike("^(?:" + "|".join(TITLES["f"]) + r")\.? $"), "given_f").otherwise("given_m")
    surname = part(F.lit("surname"), last, last)
    person = F.when(F.size(names) > 1, F.array(surname, part(given, first, first))).otherwise(F.array(surname))
    return F.when(kind == "person", person).otherwise(F.array(part(kind, _norm(kind, mention), mention)))


def _found(mentions: Column) -> Column:
    """Mentions as structs (mention, kind, parts), step by step so that nothing is worked out for each letter. A card number that Luhn's sum does not bear out is no entity and has no parts."""
    one = F.transform(mentions, lambda m: F.struct(m.alias("mention"), _kind(m).alias("kind")))
    real = lambda x: (x["kind"] != "card") | (_luhn(F.regexp_replace(x["mention"], "[^0-9]", "")) % 10 == 0)
    return F.transform(one, lambda x: F.struct(x["mention"].alias("mention"), x["kind"].alias("kind"), F.when(real(x), _parts(x["kind"], x["mention"])).alias("parts")))


def _swapped(key: str, found: Column, attempts: Column | None) -> Column:
    """What stands for each mention: the surrogates of its parts, a person's behind the title."""
    attempt = (lambda p: F.coalesce(F.try_element_at(attempts, F.concat_ws("|", p["kind"], p["norm"])), F.lit(0))) if attempts is not None else (lambda p: F.lit(0))
    tried = lambda parts: F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), p["norm"].alias("norm"), p["mention"].alias("mention"), attempt(p).alias("attempt")))
    streamed = lambda parts: F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), p["mention"].alias("mention"), p["attempt"].alias("attempt"), _stream(key, p["kind"], p["norm"], p["attempt"]).alias("stream")))
    made = lambda parts: F.transform(parts, lambda p: surrogate(key, p["kind"], p["mention"], p["stream"], p["attempt"]))
    title = lambda x: F.regexp_extract(x["mention"], rf"^(?:{_TITLE})\.? ", 0)
    whole = lambda x: F.when(x["kind"] == "person", F.concat(title(x), F.array_join(F.reverse(made(x["parts"])), " "))).otherwise(made(x["parts"])[0])
    ready = F.transform(found, lambda x: F.struct(x["mention"].alias("mention"), x["kind"].alias("kind"), streamed(tried(x["parts"])).alias("parts")))
    return F.transform(ready, lambda x: F.when(x["parts"].isNull(), x["mention"]).otherwise(whole(x)))


def mentions_of(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def settle(entities: DataFrame, key: str) -> DataFrame:
    """entities: distinct (kind, norm, mention: one of its spellings). Returns the (kind, norm, attempt) that need an attempt other than 0.

    A surrogate collides if another entity of its kind has it too or if it is itself an entity of the corpus. Of those
    that share one, the first by name keeps it; the others, and any that is an entity, try again. The space of surrogates
    grows with the attempts (that of IP addresses up to 900^4), so this ends however many entities the corpus has.
    """
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work for each: not to be put together into one task
    known = entities.select("kind", F.col("norm").alias("sur"))
    todo, kept = entities.withColumn("attempt", F.lit(0)), None
    while True:
        made = todo.withColumn("stream", _stream(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        made = checkpointed(made.select("kind", "norm", "mention", "attempt", surrogate(key, F.col("kind"), F.col("mention"), F.col("stream"), F.col("attempt")).alias("sur")))
        made = made.withColumn("sur", _norm(F.col("kind"), F.col("sur")))
        made = made if kept is None else kept.unionByName(made)
        first = made.groupBy("kind", "sur").agg(F.min("norm").alias("keeps"), F.count(F.lit(1)).alias("n"))
        same = made.join(first.where("n > 1"), ["kind", "sur"]).where("norm <> keeps").select("kind", "norm")
        real = made.join(known, ["kind", "sur"], "left_semi").select("kind", "norm")
        again = checkpointed(same.unionByName(real).distinct().withColumn("again", F.lit(1)))
        if again.isEmpty():
            return made.where("attempt > 0").select("kind", "norm", "attempt")
        marked = checkpointed(made.join(again, ["kind", "norm"], "left"))
        kept = marked.where("again is null").drop("again")
        todo = marked.where("again = 1").select("kind", "norm", "mention", (F.col("attempt") + 1).alias("attempt")).repartition(parts, "norm")


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its text rewritten and n_entities long added (an input column of that name is replaced). key is the secret that the surrogates depend on.

    Emails, phone, card (valid by Luhn), bank and social security numbers, IP addresses, secrets and titled persons get
    surrogates of their kind and format; the same entity the same one everywhere, different ones different ones. A null
    text stays null with 0 entities; empty texts, ties, repeated rows and other columns, whatever their names, stay as
    they are. An empty table gives an empty result.
    """
    body = F.col("row")[text].cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    parts = lambda found: F.flatten(F.transform(F.filter(found, lambda x: x["parts"].isNotNull()), lambda x: x["parts"]))
    some = rows.select(F.explode(parts(_found(mentions_of(body)))).alias("x")).groupBy("x.kind", "x.norm").agg(F.min("x.mention").alias("mention"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work for each: not to be put together into one task
    exceptions = checkpointed(settle(checkpointed(some.repartition(tasks, "norm")), key))
    if exceptions.isEmpty():
        ready, attempts = rows, None
    else:  # what needs another attempt is few; it meets the texts that mention it by a key of the text
        keyed = rows.where(body.rlike(HINT)).select(text_key(body).alias("key"), F.explode(parts(_found(mentions_of(body)))).alias("x")).select("key", "x.kind", "x.norm").distinct()
        by_text = keyed.join(exceptions, ["kind", "norm"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias("attempts"))
        ready, attempts = rows.withColumn("key", text_key(body)).join(by_text, "key", "left"), F.col("attempts")
    ready = ready.withColumn("found", _found(mentions_of(body)))
    swapped = _swapped(key, F.col("found"), attempts)
    new = F.array_join(F.zip_with(F.split(body, ANY, -1), swapped, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    n = F.coalesce(F.size(F.filter("found", lambda x: x["parts"].isNotNull())), F.lit(0))
    ready = ready.withColumn("n", F.when(n > 0, n).otherwise(0).cast("long"))
    ready = ready.withColumn("new", F.when(F.col("n") > 0, new).otherwise(body))
    return ready.select(*[F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != "n_entities"], F.col("n").alias("n_entities"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
