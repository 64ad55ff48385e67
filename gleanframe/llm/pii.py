"""Surrogates for personal data: keyed, type-consistent, distinct for distinct originals.

Everything runs as Spark expressions and joins.
1. One pattern finds the mentions, in one pass over the texts. Found are: e-mail addresses; keys and
   tokens (32 to 64 hexadecimal digits, common prefixed forms, JSON web tokens, private key blocks);
   IBANs, whole or in groups; telephone numbers with a plus, or of ten digits in groups; card
   numbers; US social security numbers; IPv4 and IPv6 addresses; names after a title or a label.
2. Mentions are brought to entities: telephone, card and account numbers without their marks, e-mail
   addresses in lower case, names as given name and surname without title (a Slavic woman's surname
   without its ending). So "Mr. John Smith", "Mr Smith" and "Dr. Smith" share their surname's
   surrogate, and one number has one surrogate however it is grouped.
3. Each entity gets a surrogate from a keyed hash: letters keep script and case, digits stay digits,
   check digits of cards and accounts hold where they held; a given name takes the gender that the
   titles before it show.
4. Collision checks: a surrogate that two entities got goes to one of them, and one that is itself
   an entity of the corpus goes to none; the others try again. Each attempt draws from a larger
   space, so the attempts end however many entities there are. As entities grow with the corpus,
   no join of theirs is a broadcast.
5. Texts with mentions are cut at them and joined again with the surrogates, laid out as the mention
   was. What stands between is searched for the full names and surnames of the same text's mentions,
   so a bare "John Smith" follows his titled self. A given name alone stays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Titles by gender, and titles and labels that tell none.
MALE, FEMALE, NEUTRAL = "Mr|Herr|Monsieur|Señor|Signor|г-н", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Signora|г-жа", "Dr|Prof|Professor|Doctor"
WORD = r"\p{Lu}(?:['’]\p{L})?[\p{Ll}-]++(?:\p{Lu}\p{Ll}++)?+"
#: Possessive throughout: no pattern gives back what it took, so none recurses or takes quadratic time on a long text.
KINDS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.(?=[\p{L}\p{N}]))++\p{L}{2,}+",
    "secret": r"(?<![A-Za-z0-9])(?:(?:[0-9a-f]{32,64}+|[0-9A-F]{32,64}+|(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|(?:gh[pousr]_|github_pat_|sk-|xox[abprs]-)[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9]))|-----BEGIN (?:[A-Z]{1,9} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
    "phone": r"(?<![\p{L}\d+])\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\p{L}\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}+(?![ .-]?\d)|(?<![\p{L}\d+])\+(?=(?:[ .-]?\d){8,15}+(?![ .-]?\d))\d{1,3}(?:[ .-]?\d{1,12}){1,5}+|(?<![\p{L}\d])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\p{L}\d.,+-])(?<!\d )\d{3} \d{3} \d{4}(?! ?[\d-])",
    "card": r"(?<![\p{L}\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19}+|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\d])",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ip6": r"(?<![\p{L}\d:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}+(?::[0-9A-Fa-f]{1,4}){1,5}+)(?![\p{L}\d:])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {WORD}(?: {WORD})?+|(?:Name|Contact|Author): {WORD} {WORD})",
}
#: Nothing begins inside a word, or with other characters than these: one look tells so for all kinds.
PATTERN = rf"(?<!\p{{L}})(?=[\p{{L}}\p{{N}}._%+(-])(?:{'|'.join(KINDS.values())})"
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
#: Names by script: given names of men and women; beginnings, middles and ends of surnames; ends of further given names.
GIVEN = {
    "latin": ("Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leon Max Noel Oscar Paul Simon", "Ada Bella Clara Diana Emma Flora Greta Helen Ida Julia Karla Laura Maria Nora Olga Petra"),
    "cyrillic": ("Андрей Борис Виктор Глеб Денис Егор Иван Кирилл", "Анна Вера Галина Дарья Елена Жанна Ирина Ксения"),
    "greek": ("Αλέξης Γιάννης Δήμος Ηλίας Θάνος Κώστας Λάμπρος Μάνος", "Άννα Βάσω Δήμητρα Ελένη Ζωή Ηρώ Κάτια Μαρία"),
}
PARTS = {
    "latin": ("Al Ber Cor Dal El Far Gar Hol Kel Lor Mar Nor Or Pel Ros Tor", "an en in on ar er or el il ol", "berg dale feld field hart holm mann ton vale wood", "o os us", "a ia ina"),
    "cyrillic": ("Ал Бер Вол Гор Дол Кор Лав Мар Нов Пет", "ан ен ин он ар ер", "ов ев ин", "ий ей ан", "а ия ина"),
    "greek": ("Αλ Βερ Γορ Δελ Καρ Λαμ Μαρ Νικ Παπ Στα", "αν εν ιν ον αρ ερ", "ιδης οπουλος ακης", "ος ης ας", "α η ια"),
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
DIGITS = "0123456789"
#: What of a secret names its form and stays.
PREFIX = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|sk-|xox[abprs]-|eyJ|-----BEGIN (?:[A-Z]{1,9} ){0,3}PRIVATE KEY-----)?"


def kind(value: Column) -> Column:
    """The kind of a mention: the first whose pattern the whole value matches."""
    out = F.lit("person")
    for name in reversed([k for k in KINDS if k != "person"]):
        out = F.when(value.rlike(f"^(?:{KINDS[name]})$"), F.lit(name)).otherwise(out)
    return out


def found(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0))


def of_script(value: Column, then: Callable[[str], Column]) -> Column:
    out = then("latin")
    for script, letters in SCRIPTS.items():
        out = F.when(value.rlike(letters), then(script)).otherwise(out)
    return out


def _picked(seed: Column, at: Column | int, words: str) -> Column:
    """One of ``words`` (or of its letters, if it has no space), by the seed and a number."""
    of = words.split() if " " in words else list(words)
    place = F.pmod(F.xxhash64(seed, at if isinstance(at, Column) else F.lit(at)), F.lit(len(of))) + 1
    return F.element_at(F.lit(of), place.cast("int"))


def _digits(seed: Column, at: int, count: int) -> Column:
    return F.concat(*[_picked(seed, at + i, DIGITS) for i in range(count)]) if count else F.lit("")


def disguised(value: Column, seed: Column) -> Column:
    """Every letter and digit drawn anew: of the same script, case and class (hexadecimal stays so); all else as it is."""
    hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")

    def drawn(c: Column, i: Column) -> Column:
        letter = F.when(hexadecimal, _picked(seed, i, "abcdef")).otherwise(of_script(c, lambda s: _picked(seed, i, LETTERS[s])))
        return F.when(c.rlike(r"\d"), _picked(seed, i, DIGITS)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), drawn), "")


def luhn(body: Column) -> Column:
    """The digit that makes ``body`` with it a valid card number."""
    digit = lambda c: c.try_cast("int")
    value = lambda c, i: F.when(i % 2 == 0, 2 * digit(c) - F.when(digit(c) > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(digit(c))
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), value), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10))


def iban_checks(country: Column, rest: Column) -> Column:
    """The two check digits of an account number: 98 less its remainder by 97, letters as 10 to 35."""
    step = lambda a, c: F.when(c.rlike(r"\d"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.lpad((98 - F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step)).cast("string"), 2, "0")


def surrogate(canon: Column, of: Column, form: Column, key: str, attempt: int) -> Column:
    """The surrogate of the entity ``canon`` of kind ``of`` at the given attempt; later attempts draw from larger spaces."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), of, canon, F.lit(str(attempt))), 256)
    after = lambda c, head: F.substring(c, F.char_length(head) + 1, F.char_length(c))
    more = _digits(seed, 500, attempt // 8)
    email = F.concat(disguised(F.substring_index(canon, "@", 1), seed), F.lit("@mail"), _picked(seed, -1, "123456789"), _digits(seed, 600, attempt), F.lit(".example."), _picked(seed, -2, "com net org"))
    octet = lambda i: F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(256)).cast("string")
    # The private network first; where it fills up, all of the address space.
    address = F.concat_ws(".", F.lit("10") if attempt < 4 else octet(0), octet(1), octet(2), octet(3))
    code = F.regexp_extract(canon, r"^(?:\+(?:[17]|\d{2})|\d)", 0)
    phone = F.concat(code, disguised(after(canon, code), seed), more)
    body = F.concat(F.substring(canon, 1, 1), disguised(F.substring(canon, F.lit(2), F.char_length(canon) - 2), seed), more)
    # The check digit is right where the original's is, and else wrong.
    right = luhn(F.substring(canon, F.lit(1), F.char_length(canon) - 1)).cast("string") == F.substring(canon, -1, 1)
    card = F.concat(body, F.pmod(luhn(body) + F.when(right, F.lit(0)).otherwise(F.lit(1)), F.lit(10)).cast("string"))
    country, bban = F.substring(canon, 1, 2), F.concat(disguised(F.substring(canon, F.lit(5), F.char_length(canon)), seed), more)
    valid = iban_checks(country, F.substring(canon, F.lit(5), F.char_length(canon))) == F.substring(canon, 3, 2)
    iban = F.concat(country, F.when(valid, iban_checks(country, bban)).otherwise(_digits(seed, 700, 2)), bban)
    prefix = F.regexp_extract(canon, PREFIX, 0)
    secret = F.concat(prefix, disguised(after(canon, prefix), seed), more)
    syllables = lambda s, n: [_picked(seed, 20 + i, PARTS[s][1]) for i in range(n)]
    surname = of_script(canon, lambda s: F.concat(_picked(seed, 10, PARTS[s][0]), *syllables(s, 1 + attempt), _picked(seed, 11, PARTS[s][2])))
    woman = (form == "f") | ((form == "") & (F.pmod(F.xxhash64(seed, F.lit(12)), F.lit(2)) == 0))
    name = lambda s, w: _picked(seed, 13, GIVEN[s][w]) if attempt == 0 else F.concat(_picked(seed, 13, PARTS[s][0]), *syllables(s, attempt), _picked(seed, 14, PARTS[s][3 + w]))
    given = F.when(woman, of_script(canon, lambda s: name(s, 1))).otherwise(of_script(canon, lambda s: name(s, 0)))
    out = F.when(of == "email", email).when(of == "ip", address).when(of == "phone", phone).when(of == "card", card).when(of == "iban", iban).when(of == "surname", surname).when(of == "given", given)
    return out.when(of == "ssn", F.concat(F.lit("9"), disguised(F.substring(canon, F.lit(2), F.char_length(canon)), seed), more)).when(of == "ip6", F.concat(disguised(canon, seed), _digits(seed, 800, attempt // 32))).otherwise(secret)


def mentions_of(values: DataFrame) -> DataFrame:
    """(value) with kind, and its entities: ``canon`` (of a name its surname), for names also title, given, gender and whether the surname had a woman's ending."""
    value, is_name = F.col("value"), F.col("kind") == "person"
    title = F.substring_index(value, " ", 1)
    words = F.split(F.substring(value, F.char_length(title) + 2, F.char_length(value)), " ")
    last = F.element_at(words, -1)
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\.?$"), F.lit("f")).when(title.rlike(rf"^(?:{MALE})\.?$"), F.lit("m")).otherwise(F.lit(""))
    ending = (F.col("gender") == "f") & F.col("surname").rlike("(?:ов|ев|ёв|ин|ын)а$")
    plain = F.when(F.col("kind").isin("phone", "card", "ssn", "iban"), F.regexp_replace(value, r"[^\p{L}\p{N}+]", "")).when(F.col("kind").isin("email", "ip6"), F.lower(value)).otherwise(value)
    out = values.withColumn("kind", kind(value))
    out = out.withColumn("title", F.when(is_name, title)).withColumn("given", F.when(is_name & (F.size(words) > 1), words[0])).withColumn("surname", F.when(is_name, last)).withColumn("gender", F.when(is_name, gender))
    out = out.withColumn("ending", F.coalesce(is_name & ending, F.lit(False)))
    return out.withColumn("canon", F.when(F.col("ending"), F.regexp_replace("surname", "а$", "")).when(is_name, F.col("surname")).otherwise(plain))


def entities_of(mentions: DataFrame) -> DataFrame:
    """(kind, canon, form), each once; the form of a given name is the gender that any title before it shows."""
    one = mentions.select(F.when(F.col("kind") == "person", F.lit("surname")).otherwise(F.col("kind")).alias("kind"), "canon", F.lit("").alias("form"))
    given = mentions.where("given is not null").select(F.lit("given").alias("kind"), F.col("given").alias("canon"), F.col("gender").alias("form"))
    return one.unionByName(given).groupBy("kind", "canon").agg(F.max("form").alias("form"))


def assign(scratch: Scratch, entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate): one-to-one, and no surrogate is an entity.

    Of several entities with one surrogate the least keeps it; the rest, and those whose
    surrogate is an entity or already given, try the next attempt.
    """
    todo, done, i = entities, None, 0
    while True:
        tried = todo.withColumn("surrogate", surrogate(F.col("canon"), F.col("kind"), F.col("form"), key, i))
        free = tried.join(entities.select(F.col("canon").alias("surrogate")).distinct().hint("merge"), "surrogate", "left_anti")
        if done is not None:
            free = free.join(done.select("surrogate").hint("merge"), "surrogate", "left_anti")
        won = scratch.table(f"won-{i}", free.groupBy("surrogate").agg(F.min(F.struct("canon", "kind")).alias("w")).select("w.kind", "w.canon", "surrogate"))
        done = won if done is None else done.unionByName(won)
        todo = scratch.table(f"todo-{i}", todo.join(won.select("kind", "canon").hint("merge"), ["kind", "canon"], "left_anti"))
        if todo.isEmpty():
            return done
        i += 1


def laid_out(value: Column, new: Column) -> Column:
    """The letters and digits of ``new`` in place of those of ``value``; what ``new`` has more follows at the end."""
    n = lambda upto: F.char_length(F.regexp_replace(F.substring(value, F.lit(1), upto), r"[^\p{L}\p{N}+]", ""))
    put = F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}+]"), F.substring(new, n(i + 1), F.lit(1))).otherwise(c))
    return F.concat(F.array_join(put, ""), F.substring(new, n(F.char_length(value)) + 1, F.char_length(new)))


def replaced_mentions(mentions: DataFrame, given: DataFrame) -> DataFrame:
    """(value, kind, surrogate, bare): the text that takes a mention's place; ``bare``: what of a name follows it in its text, longest first."""
    surname = given.select(F.col("kind").alias("of"), "canon", F.col("surrogate").alias("main"))
    first = given.where("kind = 'given'").select(F.col("canon").alias("given"), F.col("surrogate").alias("first"))
    out = mentions.withColumn("of", F.when(F.col("kind") == "person", F.lit("surname")).otherwise(F.col("kind"))).join(surname.hint("merge"), ["of", "canon"]).join(first.hint("merge"), "given", "left")
    name = F.when(F.col("ending"), F.concat("main", F.lit("а"))).otherwise(F.col("main"))
    out = out.withColumn("name", F.when(F.col("kind") == "person", name))
    shown = F.when(F.col("kind") == "person", F.concat_ws(" ", "title", "first", "name")).when(F.col("kind").isin("phone", "card", "ssn", "iban"), laid_out(F.col("value"), F.col("main")))
    cased = lambda old, new: F.when(old == F.upper(old), F.upper(new)).otherwise(new)
    part = lambda of, at: F.substring_index(of, "@", at)
    mail = F.concat(cased(part("value", 1), part("main", 1)), F.lit("@"), cased(part("value", -1), part("main", -1)))
    shown = shown.when(F.col("kind") == "email", mail).when(F.col("kind") == "ip6", cased(F.col("value"), F.col("main"))).otherwise(F.col("main"))
    pair = lambda a, b: F.struct(a.alias("old"), b.alias("new"))
    full = F.when(F.col("first").isNotNull(), F.array(pair(F.concat_ws(" ", "given", "surname"), F.concat_ws(" ", "first", "name"))))
    bare = F.when(F.col("kind") == "person", F.concat(F.coalesce(full, F.array().cast("array<struct<old:string,new:string>>")), F.array(pair(F.col("surname"), F.col("name")))))
    return out.select("value", "kind", shown.alias("surrogate"), bare.alias("bare"))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", count: str | None = None, kinds: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; all columns and rows stay.

    ``count`` and ``kinds`` name columns to add: how many mentions were replaced, and their kinds.
    Null text stays null, empty text empty; a text of any length is searched whole. Repeated rows
    and equal ids are rows like others; an empty table stays empty. Other columns, whatever their
    names, are carried as they are.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    names: Sequence[str] = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    field = lambda c: F.col("row").getField(f"c{names.index(c)}")
    # Written once, so the pattern runs over each text once.
    marked = scratch.table("marked", docs.select(row.alias("row"), found(f"`{text}`").alias("values"), F.monotonically_increasing_id().alias("row_id")))
    hit = marked.where(F.size("values") > 0)
    values = hit.select("row_id", F.posexplode("values").alias("at", "value"))
    mentions = scratch.table("mentions", mentions_of(values.select("value").distinct()))
    given = assign(scratch, scratch.table("entities", entities_of(mentions)), key)
    new = scratch.table("new", replaced_mentions(mentions, given))
    scratch.keep_only("marked", "new")
    mapped = values.join(new.hint("merge"), "value").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate", "kind"))).alias("new"), F.array_distinct(F.flatten(F.collect_list("bare"))).alias("bare"))
    longest = F.array_sort("bare", lambda a, b: F.char_length(b["old"]) - F.char_length(a["old"]))
    follow = lambda piece: F.aggregate("bare", piece, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}@.])"), x["old"], F.lit(r"(?![\p{L}\p{N}@])")), x["new"]))
    pieces = F.transform(F.split(field(text), PATTERN, -1), follow)
    rebuilt = F.array_join(F.flatten(F.zip_with(pieces, F.transform("new", lambda x: x["surrogate"]), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    done = hit.select("row", "row_id").join(mapped.withColumn("bare", longest).hint("merge"), "row_id").withColumn("rebuilt", rebuilt)
    extra = lambda n, found_kinds: ([n.cast("long").alias(count)] if count else []) + ([found_kinds.alias(kinds)] if kinds else [])
    clean = marked.where(F.size("values") == 0).select(*[field(c).alias(c) for c in names], *extra(F.lit(0), F.array().cast("array<string>")))
    return clean.unionByName(done.select(*[F.col("rebuilt").alias(c) if c == text else field(c).alias(c) for c in names], *extra(F.size("new"), F.array_sort(F.array_distinct(F.transform("new", lambda x: x["kind"]))))))
