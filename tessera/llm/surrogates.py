"""PII surrogates, in DataFrame functions only.

E-mail addresses, phone and card numbers, IP addresses, secrets (long hex
strings) and names of persons are replaced by keyed surrogates of the same
type, script, gender and format.  A surrogate depends on the key and on the
entity's canonical form alone, so all mentions of one entity, however
written, get the same one (coreference).  Surrogates are checked over the
whole corpus: none is shared by two entities or equal to a real one; those
that clash are drawn again, until none does.  Further bare mentions of a
surname found in a document are replaced in it too.

Not detected: names without a title or a given name of the list, or whose
given name is in capitals; initials are kept; phone numbers without a + or 00
that are not of ten digits; postal addresses, dates of birth, IPv6 addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_key
from tessera.session import ensure_checkpoint_dir

#: Given names by script and gender, titles, and syllables of
#: made-up surnames by script.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Peter Paul Hans Karl Pierre Jean Carlos Juan",
    ("latin", "f"): "Mary Patricia Linda Barbara Elizabeth Susan Sarah Anna Julia Emma Claudia Petra Marie Sophie Carmen Lucia",
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Павел Андрей",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана",
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Sr Sra"
SYLLABLES = {"latin": "ba be bo da de do ka ke ko la le lo ma me mo ra re ro sa se so ta te to va ve vo".split(),
             "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо ра ре ро са се со та те то ва ве во".split()}

PARTICLES = "van von der den de da di del dos du la le bin al"

_NAMES = "|".join(" ".join(GIVEN.values()).split())
_MAIL = r"\p{L}\p{M}\p{N}_.%+-"
_GIVEN = rf"(?:{_NAMES})(?:-(?:{_NAMES}))?"
#: A surname, with hyphens and apostrophes but without a genitive 's, and
#: what may stand before it.
_SURNAME = r"\p{Lu}(?:\p{L}|['’-]\p{L}{2})\p{L}*+(?:['’-]\p{L}{2,}+)*+"
_LINKS = rf"(?:(?:\p{{Lu}}\.|{PARTICLES.replace(' ', '|')}) ){{0,4}}"
#: Types in the order in which they are tried, and their patterns.
PATTERNS = (
    ("email", rf"(?<![{_MAIL}])[{_MAIL}]++(?:'[{_MAIL}]++)*+@(?:[\p{{L}}\p{{M}}\p{{N}}-]+\.)+[\p{{L}}\p{{M}}]{{2,}}"),
    ("secret", r"(?<!\w)(?=[a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{32,}(?!\w)"),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"),
    ("phone", r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
              r"|(?:\+|00(?=[1-9]))\d(?:[ ()./-]{0,2}\d){7,14})(?!\w)"),
    ("card", r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)"),
    ("phone", r"(?<![\w.+-])[2-9]\d{9}(?!\w|[.-]\d)"),
    ("name", rf"(?<!\p{{L}})(?:(?:{TITLES.replace(' ', '|')})\.? (?:{_GIVEN} )?{_LINKS}{_SURNAME}(?: {_LINKS}{_SURNAME}){{0,2}}"
             rf"|{_GIVEN} {_LINKS}{_SURNAME}(?: {_LINKS}{_SURNAME}){{0,2}})(?!\p{{L}})"),
)
ANY = "|".join(p for _, p in PATTERNS)
#: What every entity holds at least; much cheaper to look for.
HINT = rf"[0-9@]|{TITLES.replace(' ', ' |')} |(?:{TITLES.replace(' ', '|')})\. |{_NAMES.replace('|', ' |')} "


def kind_of(mention: Column) -> Column:
    """The type whose pattern matches the whole mention."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in PATTERNS:
        out = out.when(mention.rlike(rf"\A(?:{pattern})\z"), F.lit(name))
    return out


def canonical(kind: Column, raw: Column) -> Column:
    return F.when(kind.isin("phone", "card"), F.regexp_replace(raw, r"\D", "")).otherwise(F.lower(raw))


def _stream(secret: str, kind: Column, canon: Column, draw: int) -> Column:
    """Keyed hex digits, two for every character of the canonical form and
    a few more."""
    seed = F.concat_ws("\x1f", F.lit(secret), kind, canon, F.lit(str(draw)))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(canon) / 48).cast("int")), lambda i: F.sha2(
        F.concat(seed, F.lit("\x1f"), i.cast("string")), 512)), "")


def _byte(stream: Column, k: Column) -> Column:
    return F.conv(F.substring(stream, 2 * k + 1, F.lit(2)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), F.pmod(n, F.lit(len(chars))) + 1, F.lit(1))


def _swap(canon: Column, stream: Column, fixed: Column, letters: str) -> Column:
    """Letters to keyed letters, digits to keyed digits, the rest and the
    places where ``fixed(k)`` holds unchanged."""
    def one(ch, k):
        n = _byte(stream, k)
        return F.when(fixed(k), ch).when(ch.rlike(r"\d"), _pick("0123456789", n)) \
            .when(ch.rlike(r"\p{L}"), _pick(letters, n)).otherwise(ch)
    return F.array_join(F.transform(F.split(canon, ""), one), "")


def _luhn(digits: Column, double_last: bool) -> Column:
    """Luhn sum; ``double_last`` for a number whose check digit is missing."""
    n = F.length(digits)

    def value(ch, k):
        d = ch.cast("int")
        twice = F.pmod(n - k, F.lit(2)) == (1 if double_last else 0)
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, b: a + b)


def surrogate(kind: Column, canon: Column, secret: str, draw: int) -> Column:
    """Surrogate of a canonical form, itself canonical.

    email: letters and digits swapped, the top-level domain kept, longer with
    later draws; secret: hex digits; ip: four numbers of 1 to 254; phone: the
    country code kept; card: the first digit and whether the Luhn check holds
    kept; surname: syllables of the same script, more with later draws.
    """
    s = _stream(secret, kind, canon, draw)
    lower = "abcdefghijklmnopqrstuvwxyz"
    top = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    email = _swap(canon, s, lambda k: k >= top, lower)
    if draw > 2:
        extra = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(draw)), lambda k: _pick(lower, _byte(s, k + 40))), "")
        email = F.concat(extra, email)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)),
                                  lambda k: (F.pmod(_byte(s, k), F.lit(254)) + 1).cast("string")), ".")
    phone = _swap(canon, s, lambda k: k < F.length(canon) - 10, lower)
    body = _swap(F.substring(canon, F.lit(1), F.length(canon) - 1), s, lambda k: k < 1, lower)
    due = F.pmod(-_luhn(body, True), F.lit(10))
    check = F.when(F.pmod(_luhn(canon, False), F.lit(10)) == 0, due) \
        .otherwise(F.pmod(due + 1 + F.pmod(_byte(s, F.lit(62)), F.lit(9)), F.lit(10)))
    def made_up(script):
        table = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2 + draw)), lambda k: F.element_at(
            table, F.pmod(_byte(s, k), F.lit(len(SYLLABLES[script]))) + 1)), "")
    return F.when(kind == "email", email).when(kind == "secret", _swap(canon, s, lambda k: F.lit(False), "abcdef")) \
        .when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", F.concat(body, check.cast("string"))) \
        .when(canon.rlike(r"\p{IsCyrillic}"), made_up("cyrillic")).otherwise(made_up("latin"))


def in_format(kind: Column, raw: Column, new: Column) -> Column:
    """A canonical surrogate written like the mention: separators of numbers,
    case of letters."""
    def digit(ch, k):
        before = F.length(F.regexp_replace(F.substring(raw, F.lit(1), k), r"\D", ""))
        return F.when(ch.rlike(r"\d"), F.substring(new, before + 1, F.lit(1))).otherwise(ch)
    def cased(ch, k):
        return F.when(F.substring(raw, k + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(ch)).otherwise(ch)
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    same_length = F.array_join(F.transform(F.split(new, ""), cased), "")
    return F.when(kind.isin("phone", "card"), F.array_join(F.transform(F.split(raw, ""), digit), "")) \
        .when(upper, F.upper(new)).when(kind == "surname", F.initcap(new)) \
        .when(F.length(raw) == F.length(new), same_length).otherwise(new)


def _given(token: Column, secret: str) -> Column:
    """Another given name of the same script and gender: a keyed turn of the
    list, so no two names share one and none stays."""
    out = F.when(F.lit(False), F.lit(""))
    for (script, gender), names in GIVEN.items():
        names = names.split()
        turn = F.pmod(F.conv(F.substring(F.sha2(F.lit(f"{secret}{script}{gender}"), 256), 1, 6), 16, 10).cast("int"),
                      F.lit(len(names) - 1)) + 1
        table = F.array(*[F.lit(x) for x in names])
        out = out.when(token.isin(*names), F.element_at(
            table, F.pmod(F.array_position(table, token) - 1 + turn, F.lit(len(names))).cast("int") + 1))
    return out


def _drawn(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, canon, new): a surrogate for every entity, all distinct within a
    kind and none a real entity."""
    left, done, draw = entities, None, 0
    while True:
        tried = left.withColumn("new", surrogate(F.col("kind"), F.col("canon"), secret, draw))
        first = tried.groupBy("kind", "new").agg(F.min("canon").alias("canon"))
        real = entities.select("kind", F.col("canon").alias("new"))
        good = first.join(real, ["kind", "new"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        good = good.select("kind", "canon", "new").checkpoint()
        done = good if done is None else done.unionByName(good)
        left = left.join(good, ["kind", "canon"], "left_anti").checkpoint()
        if left.isEmpty():
            return done
        draw += 1


def replace_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", secret: str = "tessera",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, n_entities, kinds) of every document, entities replaced,
    and the further columns named in ``carry`` as they are.

    ``secret`` is the key; another key gives other surrogates.  ``kinds`` are
    the sorted types found.  Null text: null, 0 entities.  Rows that repeat
    an id are documents of their own; an empty table gives no row.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None)
    rows = row_key(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), rest.alias("rest")))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = rows.withColumn("mentions", F.when(hinted, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
                            .otherwise(F.array().cast("array<string>")))
    held = found.where(F.size("mentions") > 0).checkpoint()
    mention = held.select("id", "occ", F.explode(F.array_distinct("mentions")).alias("mention")) \
        .withColumn("kind", kind_of(F.col("mention")))
    # a name is taken apart into its words, everything else is one unit
    units = mention.select("id", "occ", "mention", F.col("kind").alias("whole"), F.posexplode(
        F.when(F.col("kind") == "name", F.split("mention", " ")).otherwise(F.array("mention"))).alias("at", "raw"))
    titles = F.regexp_replace("raw", r"\.\z", "").isin(*TITLES.split())
    links = F.col("raw").isin(*PARTICLES.split()) | F.col("raw").rlike(r"\A\p{Lu}\.\z")
    kept = (F.col("whole") == "name") & (titles | links | F.col("raw").isin(*_NAMES.split("|")))
    units = units.withColumn("kind", F.when(kept, F.lit(None)).when(F.col("whole") == "name", F.lit("surname"))
                             .otherwise(F.col("whole"))) \
        .withColumn("canon", canonical(F.col("kind"), F.col("raw")))
    entities = units.where("kind is not null").select("kind", "canon").distinct().checkpoint()
    drawn = _drawn(entities, secret)
    named = units.where("kind is not null").join(drawn, ["kind", "canon"]) \
        .withColumn("new", in_format(F.col("kind"), F.col("raw"), F.col("new"))) \
        .select("id", "occ", "mention", "whole", "at", "new", F.when(F.col("kind") == "surname", F.struct(
            (-F.length("raw")).alias("n"), "raw", "new")).alias("surname"))
    plain = units.where("kind is null").select("id", "occ", "mention", "whole", "at",
                                               F.coalesce(_given(F.col("raw"), secret), F.col("raw")).alias("new"),
                                               F.lit(None).alias("surname"))
    replaced = named.unionByName(plain).groupBy("id", "occ", "mention", "whole").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda u: u["new"]), " ").alias("new"),
        F.collect_set("surname").alias("surnames"))
    maps = replaced.groupBy("id", "occ").agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("map"),
        F.array_sort(F.collect_set("whole")).alias("kinds"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("surnames")))).alias("surnames"))
    back = [F.col(f"rest.`{c}`").alias(c) for c in carry]
    parts = F.split("text", ANY, -1)
    n = F.size("mentions")
    # longer surnames first; no surrogate is a real surname, so none is met again
    bare = lambda s: F.concat(F.lit(r"(?<!\p{L})\Q"), s["raw"], F.lit(r"\E(?!\p{L})"))
    renamed = F.transform("parts", lambda p: F.aggregate("surnames", F.struct(p.alias("text"), F.lit(0).alias("n")), lambda a, s: F.struct(
        F.regexp_replace(a["text"], bare(s), s["new"]).alias("text"), (a["n"] + F.regexp_count(a["text"], bare(s))).alias("n"))))
    plain_parts = F.transform("parts", lambda p: F.struct(p.alias("text"), F.lit(0).alias("n")))
    whole = F.concat(F.array_join(F.zip_with(F.slice(F.col("parts"), F.lit(1), n), "mentions",
                                             lambda p, m: F.concat(p["text"], F.col("map")[m])), ""), F.element_at("parts", -1)["text"])
    changed = held.alias("h").join(maps.alias("m"), F.expr("h.id <=> m.id and h.occ = m.occ")) \
        .withColumn("parts", parts).withColumn("parts", F.when(F.size("surnames") > 0, renamed).otherwise(plain_parts)) \
        .select(F.col("h.id").alias(id_col), whole.alias(text_col),
                (n + F.aggregate("parts", F.lit(0), lambda k, p: k + p["n"])).alias("n_entities"), "kinds", *back)
    same = found.where((F.size("mentions") == 0) | F.col("text").isNull()) \
        .select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.lit(0).alias("n_entities"),
                F.array().cast("array<string>").alias("kinds"), *back)
    return same.unionByName(changed)
