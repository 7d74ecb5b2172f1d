"""PII: surrogate generation with keyed, type-consistent replacements.

1. One pattern finds the mentions of every text: e-mail addresses, telephone numbers, payment
   cards, IBANs, IPv4 addresses, social security numbers, person names (given name of a lexicon and
   surname), access keys, passwords and hexadecimal tokens.
2. A mention's canonical form makes coreference: case of addresses and names, separators and the
   country code of numbers do not matter. Each distinct entity gets one surrogate from a keyed
   SHA-256 stream: letters become letters of the same script, case and vowel class, digits become
   digits, prefixes and separators stay, cards keep whether their check digit is right, a given name
   becomes one of the same gender and script, addresses end in a reserved domain.
3. Collision checks: a surrogate that another entity of its type has, or that occurs in the corpus
   as an entity itself, is drawn again (the smallest canonical form keeps it) until none collides.
   After LENGTHEN draws every further one is a character longer than the one before, so that values
   without a letter or digit to change, or of a small space that the corpus has used up, end too: a
   value longer than all real ones can only meet another surrogate, with ever smaller chance. Only
   then is a number longer than its format says.
4. Surrogates are rendered in each mention's own format and put in place of the mentions.

Everything is DataFrame functions. Only texts with mentions are shuffled, by document; an entity in
a third of all texts is one row of the entity table, and the join to its mentions is one that
adaptive execution can split.

Nulls, ties, odd input: a null text stays null; a text without mentions is returned unchanged; rows
that repeat a doc_id are told apart by their text's hash, and equal rows are all returned; a null
doc_id is kept; an empty table gives no rows; very long texts are read whole; other columns of the
input are kept, but for n_entities, which is replaced; helper columns have names that start with "_pii".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Given names by gender and script (fixed values).
GIVEN = {
    ("f", "latin"): ["Anna", "Maria", "Emma", "Julia", "Laura", "Sarah", "Alice", "Claire", "Carmen", "Lucia", "Sophie", "Helen", "Martha", "Ingrid", "Elena", "Nora"],
    ("m", "latin"): ["John", "Peter", "Paul", "David", "Thomas", "Michael", "James", "Robert", "Carlos", "Miguel", "Pierre", "Hans", "Klaus", "Daniel", "Martin", "Oscar"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Татьяна", "Наталья", "Светлана"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Андрей"],
}
#: Mention patterns in order of precedence (fixed values).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "password": r"(?i:password|passwd|pwd|secret)[=:][^\s\"']{6,}",
    "access_key": r"\bAKIA[A-Z0-9]{16}\b",
    "token": r"\b(?=[a-f]*[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9.-])[0-9]{4}([ -]?)[0-9]{4}(?:[ -]?[0-9]{4}){2}(?![0-9-]|\.[0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b|(?<![0-9.-])(?:\+[0-9]{1,3}[ .-]?)?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"\b(?=\p{Lu}\p{Ll}+ \p{Lu}\p{Ll})(?:" + "|".join(n for names in GIVEN.values() for n in names) + r") \p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every mention holds, cheap to look for: a digit or a sign, the head of a key, or a given name before a capital.
HINT = r"[0-9@=:]|AKIA|(?=\p{Lu})(?:" + "|".join(n for names in GIVEN.values() for n in names) + r") \p{Lu}"
DIGITS_ONLY = ("card", "ssn", "phone")
#: After so many draws a surrogate is lengthened, by one more character each time.
LENGTHEN = 6
ENTITIES_A_TASK = 4000
#: Letters that stand for those of a script besides Latin and Cyrillic (fixed values).
SCRIPTS = {"Greek": "αεηιουβγδζθκλμνπρστφχ", "Han": "王李张刘陈杨赵黄周吴", "Hiragana": "あいうえおかきくけこさしすせそ", "Katakana": "アイウエオカキクケコサシスセソ", "Hangul": "김이박최정강조윤장임", "Arabic": "ابتحدرسعفقلمنهوي", "Hebrew": "אבגדהוזחטילמנסעפ", "Devanagari": "अकगजटतदनपमरलवस", "Thai": "กขคงจชซญดตถทนบปผ"}
LATIN_VOWELS, LATIN_CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxz"
CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "аеиоу", "бвгдзклмнпрст"


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind, p in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind.isin("email", "name"), F.lower(mention))
        .when(kind == "password", F.regexp_replace(mention, "^[^=:]*[=:]", ""))
        .otherwise(mention)
    )


def drawn(secret: str, kind: Column, value: Column, attempt: Column, i: Column) -> Column:
    """A number below 2^28 from the keyed stream."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\u0001", F.lit(secret), kind, value, attempt.cast("string"), i.cast("string")), 256), 1, 7), 16, 10).cast("long")


def like(secret: str, kind: Column, value: Column, attempt: Column, hexadecimal: bool = False) -> Column:
    """value with each letter and digit replaced by one of its class; anything else stays."""

    def one(c: Column, i: Column) -> Column:
        n = drawn(secret, kind, value, attempt, i)
        pick = lambda s: F.substring(F.lit(s), F.pmod(n, F.lit(len(s))).cast("int") + 1, F.lit(1))
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), pick("0123456789abcdef")).otherwise(c)
        low = F.lower(c)
        new = F.when(low.rlike("[aeiouyà-æè-ïò-öø-ý]"), pick(LATIN_VOWELS)).when(low.rlike("[a-zçñß]"), pick(LATIN_CONSONANTS))
        new = new.when(low.rlike("[аеёиоуыэюя]"), pick(CYRILLIC_VOWELS)).when(low.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC_CONSONANTS))
        new = new.when(low.rlike("[ăąāęėēěįīőōųūůűœæ]"), pick(LATIN_VOWELS)).when(low.rlike(r"(?=\p{L})\p{IsLatin}"), pick(LATIN_CONSONANTS))
        for script, letters in SCRIPTS.items():
            new = new.when(low.rlike(rf"(?=\p{{L}})\p{{Is{script}}}"), pick(letters))
        new = new.when(low.rlike(r"\p{L}"), pick(LATIN_CONSONANTS))
        new = F.when(c != low, F.upper(new)).otherwise(new)
        first = (i == 0) & kind.isin("phone", "card", "ssn")  # a number's first digit is not 0 or 1
        digit = F.when(first, pick("23456789")).otherwise(pick("0123456789"))
        return F.when(c.rlike("[0-9]"), digit).when(new.isNotNull(), new).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for a right check digit."""
    n = F.length(digits)

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - 1 - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), term), F.lit(0), lambda a, b: a + b)


def lengthening(secret: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Nothing for the first LENGTHEN draws; then 4, 5, ... characters, digits where the kind has digits only, else letters."""
    stream = F.substring(F.sha2(F.concat_ws("\u0001", F.lit(secret), kind, value, attempt.cast("string"), F.lit("longer")), 256), F.lit(1), F.least(F.lit(64), attempt - LENGTHEN + 4).cast("int"))
    digits, letters = F.translate(stream, "abcdef", "012345"), F.translate(stream, "0123456789", "ghijklmnop")
    longer = F.when(kind.isin(*DIGITS_ONLY, "ipv4", "iban"), digits).when(kind == "token", stream).when(kind == "access_key", F.upper(letters)).otherwise(letters)
    return F.when(attempt >= LENGTHEN, longer).otherwise("")


def surrogate(secret: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The surrogate of a canonical form, itself in canonical form."""
    more = lengthening(secret, kind, value, attempt)
    plain = like(secret, kind, value, attempt)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(drawn(secret, kind, value, attempt, i), F.lit(254)) + 1).cast("string")), ".")
    head = F.substring(plain, 1, 15)
    right = F.pmod(F.lit(10) - luhn(F.concat(head, F.lit("0"))) % 10, F.lit(10))
    good = luhn(value) % 10 == 0
    card = F.concat(head, F.when(good, right).otherwise((right + 1 + F.pmod(drawn(secret, kind, value, attempt, F.lit(99)), F.lit(9))) % 10).cast("string"))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    reserved = F.when(domain.rlike(r"(^|\.)example\.(com|org|net)$"), F.concat(F.regexp_replace(like(secret, kind, domain, attempt), r"(^|\.)[^.]*\.[^.]*$", "$1"), F.regexp_extract(domain, r"example\.[a-z]+$", 0))).otherwise(F.concat(F.regexp_replace(like(secret, kind, domain, attempt), r"\.[^.]*$", ""), F.lit(".example")))
    email = F.concat(like(secret, kind, local, attempt), more, F.lit("@"), reserved)
    given, surname = F.substring_index(value, " ", 1), F.substring_index(value, " ", -1)
    new_given = F.lit(None).cast("string")
    for names in GIVEN.values():
        low = [n.lower() for n in names]
        at = F.array_position(F.array(*map(F.lit, low)), given)
        step = F.pmod(drawn(secret, kind, value, attempt, F.lit(-1)), F.lit(len(low) - 1)) + 1  # never the same name
        new_given = F.when(at > 0, F.element_at(F.array(*map(F.lit, low)), (F.pmod(at - 1 + step, F.lit(len(low))) + 1).cast("int"))).otherwise(new_given)
    return F.when(kind == "email", email).otherwise(F.concat(
        F.when(kind == "ipv4", octets)
        .when(kind == "card", card)
        .when(kind == "token", like(secret, kind, value, attempt, hexadecimal=True))
        .when(kind == "access_key", F.concat(F.lit("AKIA"), F.upper(like(secret, kind, F.substring(value, 5, 16), attempt))))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), like(secret, kind, F.expr("substring(canon, 3)"), attempt)))
        .when(kind == "name", F.concat(new_given, F.lit(" "), like(secret, kind, surname, attempt)))
        .otherwise(plain),
        more,
    ))


def entities(mentions: DataFrame, secret: str) -> DataFrame:
    """(kind, canon, fake) of the distinct entities of mentions(kind, canon); no two fakes of a kind agree and none is real."""
    known = written(mentions.select("kind", "canon").distinct())
    settled, open_ = None, known.withColumn("attempt", F.lit(0))
    real = known.select("kind", F.col("canon").alias("fake"))
    while True:
        # few wide rows would be one file and so one task
        open_ = open_.repartition(1 + open_.count() // ENTITIES_A_TASK)
        tried = written(open_.withColumn("fake", surrogate(secret, F.col("kind"), F.col("canon"), F.col("attempt"))))
        first = tried.groupBy("kind", "fake").agg(F.min("canon").alias("canon"))
        good = first.join(real, ["kind", "fake"], "left_anti")
        if settled is not None:
            good = good.join(settled.select("kind", "fake"), ["kind", "fake"], "left_anti")
        good = written(good.select("kind", "canon", "fake"))
        settled = good if settled is None else settled.unionByName(good)
        open_ = written(tried.join(good.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        if not open_.limit(1).count():
            return written(settled)


def rendered(kind: Column, mention: Column, fake: Column) -> Column:
    """fake in the mention's own format."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    total = F.length(F.regexp_replace(mention, "[^0-9]", ""))
    before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^0-9]", ""))
    kept = total - F.length(fake)  # digits of a country code
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]") & (before(i) >= kept), F.substring(fake, (before(i) - kept + 1).cast("int"), F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(fake, (i + 1 - F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^ ]", ""))).cast("int"), F.lit(1)))), "")
    return (
        F.when(kind.isin(*DIGITS_ONLY) & (kept < 0), fake)
        .when(kind.isin(*DIGITS_ONLY), digits)
        .when(kind == "iban", spaced)
        .when(kind == "name", F.regexp_replace(F.initcap(F.regexp_replace(fake, "-", "- ")), "- ", "-"))
        .when(kind == "password", F.concat(F.regexp_extract(mention, "^[^=:]*[=:]", 0), fake))
        .when((kind == "email") & (F.upper(mention) == mention), F.upper(fake))
        .otherwise(fake)
    )


def pseudonymised(docs: DataFrame, secret: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with each mention in `text` replaced, and n_entities, the number of mentions."""
    found = docs.withColumn("_pii", F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))))
    some = F.coalesce(F.size("_pii") > 0, F.lit(False))
    clean = found.where(~some).drop("_pii").withColumn("n_entities", F.lit(0))
    keyed = found.where(some).withColumn("_pii_key", F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text).cast("string")))
    mentions = keyed.select("_pii_key", F.explode(F.array_distinct("_pii")).alias("mention"))
    mentions = mentions.withColumn("kind", kind_of(F.col("mention")))
    mentions = written(mentions.withColumn("canon", canonical(F.col("kind"), F.col("mention"))))
    table_ = entities(mentions, secret)
    named = mentions.join(table_, ["kind", "canon"]).select("_pii_key", "mention", rendered(F.col("kind"), F.col("mention"), F.col("fake")).alias("fake"))
    maps = named.groupBy("_pii_key").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("mention", "fake")))).alias("_pii_map"))  # a document's own mentions
    joined = keyed.join(written(maps), "_pii_key")
    pieces = F.split(F.col(text), ANY, -1)
    fakes = F.transform("_pii", lambda m: F.element_at("_pii_map", m))
    new = F.array_join(F.zip_with(pieces, fakes, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")
    changed = joined.withColumns({text: new, "n_entities": F.size("_pii")}).select(*clean.columns)
    return clean.unionByName(changed)


def op7_surrogates(spark: SparkSession, sf_dir: str, secret: str = "corpus-key-1") -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), secret).select("doc_id", "text", "n_entities")
