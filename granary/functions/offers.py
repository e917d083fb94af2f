"""What an offer's text says: the price of a thousand points, the end of its validity, its bonus tiers.

Each is one column expression over the text; nothing is claimed that the text does not
tie down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ACCENTED, PLAIN, let

# The unit of price, the windows of characters in which a price counts as tied to it, and how prices are written.
UNIT = "milheiro"
NEAR, NEAR_CUT, NEAR_FLOOR = 40, 60, 32
MONEY = r"r\$\s*~?\s*(?:\d[\d.,]*\d|\d)"
CUT = r"de\s+r\$\s*~?\s*[\d.,]+\s+para\s+r\$\s*~?\s*(?:\d[\d.,]*\d|\d)"
ALONE = r"^\s*(?:r\$\s*)?~?\s*(\d[\d.,]*\d|\d)\s*$"
FROM = "a partir d"
# Months as they stand in addresses, and the phrases that say that there is no end, that it is today, or that an end follows.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
NO_END = r"(nao (e )?informad|nao ha data|sem data|por tempo indeterminad|enquanto durar)"
TODAY = r"(\bhoje\b|ultimo dia|ultimas horas|terminam? hoje|somente hoje|so hoje|apenas hoje|acaba hoje)"
END = r"(\bate\b|valid[oa] ate|termina|ultimo dia|vale ate|somente (hoje|nesta|neste|amanha)|so (hoje|amanha|nesta|neste|nesse)|apenas (hoje|nesta)|acaba|encerra)"
# How a bonus is written, and the words that name its audience, in order of precedence.
BONUS = r"(?i)(?:at[ée]\s+)?(\d{1,3})\s*%\s*(?:de\s+)?b[oô]nus|b[oô]nus\s+de\s+(\d{1,3})\s*%"
BEFORE, AFTER = 70, 40
AUDIENCES = (
    ("clube", r"(?i)\b(clube|assinant|categoria|diamante|plano\s+\d|\d\.\d{3})\b"),
    ("cartao", r"(?i)\b(cart[aã]o|cart[oõ]es)\b"),
    ("geral", r"(?i)\b(para\s+todos|todos\s+os|geral|qualquer)\b"),
)


def unaccented(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)


def br_price(raw: Column) -> Column:
    """1.234,56 and 1.234 (thousands) and 16.84, to the cent; null unless positive."""
    plain = F.when(F.contains(raw, F.lit(",")), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(raw.rlike(r"^\d+\.\d{3}$"), F.replace(raw, F.lit("."), F.lit(""))).otherwise(raw)
    n = F.round(F.regexp_extract(plain, r"^\d*\.?\d+", 0).try_cast("double"), 2)
    return F.when(n > 0, n)


def price_per_thousand(text: Column) -> Column:
    """(value, floor, approximate): the price of a thousand points, or null.

    "de X para Y" near the unit is Y; else the first amount near the unit, a floor where
    "a partir de" stands before it; a text that is only a number is that number.  A text
    with the unit but no amount near it has no price.
    """
    near = rf"(?s)(?:(?<={UNIT}.{{0,{NEAR}}}){MONEY}|{MONEY}(?=.{{0,{NEAR}}}{UNIT}))"

    def found(raw: Column, floor: Column) -> Column:
        value = br_price(F.regexp_extract(raw, r"(\d[\d.,]*\d|\d)\s*$", 1))
        return F.when(value.isNotNull(), F.struct(value.alias("value"), floor.alias("floor"), F.regexp_extract(raw, r"r\$\s*(~?)\s*[\d.,]+$", 1).eqNullSafe("~").alias("approximate")))

    def split(t: Column, pattern: str, body) -> Column:
        """body(before, match, behind) of the first match, null without one."""
        at = F.regexp_instr(t, F.lit(pattern))
        whole = F.regexp_substr(t, F.lit(pattern))
        return F.when(at > 0, body(F.substring(t, F.lit(1), at - 1), whole, F.substring(t, at + F.length(whole), F.length(t))))

    def of(t: Column) -> Column:
        tied = lambda a, b: F.contains(F.right(a, F.lit(NEAR_CUT + len(UNIT))), F.lit(UNIT)) | F.contains(F.left(b, F.lit(NEAR_CUT + len(UNIT))), F.lit(UNIT))
        cut = split(t, CUT, lambda a, m, b: F.when(tied(a, b), found(m, F.lit(False))))
        first = split(t, near, lambda a, m, b: found(m, F.contains(F.right(a, F.lit(NEAR_FLOOR)), F.lit(FROM))))
        alone = F.nullif(F.regexp_extract(t, ALONE, 1), F.lit(""))
        number = F.when(alone.isNotNull(), found(alone, F.lit(False)))
        return F.when(F.contains(t, F.lit(UNIT)), F.coalesce(cut, first)).otherwise(number)

    return let(F.lower(text), of)


def validity_end(text: Column, address: Column, published: Column) -> Column:
    """(day, reason): the last day of validity as yyyy-mm-dd, null where day, month and year are not all evident.

    In order: a phrase that there is no end; a full date in the address where the text
    says today; the first full date of the text; the first day and month where the text
    speaks of an end, with the year of the month in the address or of publication, or the
    next one if that month is past.  A date behind "a partir de" is a start and never
    counts.
    """
    month = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    names = "|".join(MONTHS)
    none = F.struct(F.lit(None).cast("string").alias("day"), F.lit(None).cast("string").alias("reason"))

    def outcome(reason: str, y: Column | None = None, m: Column | None = None, d: Column | None = None) -> Column:
        day = F.lit(None).cast("string") if y is None else F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        return F.struct(day.alias("day"), F.lit(reason).alias("reason"))

    def first_valid(t: Column, pattern: str) -> Column:
        """[day, month(, year)] of the first match that can be one."""
        parts = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: F.transform(F.split(x, "/"), lambda p: p.cast("int")))
        return F.get(F.filter(parts, lambda p: p[0].between(1, 31) & p[1].between(1, 12)), F.lit(0))

    def of(both: Column) -> Column:
        t, s = both["t"], both["s"]
        ends = F.regexp_replace(t, rf"({FROM}.{{0,6}}?)\d{{1,2}}/\d{{1,2}}(/\d{{2,4}})?", "$1 ")
        in_address = F.regexp_extract(s, rf"\b(\d{{1,2}})({names})(\d{{2}})\b", 0)
        a = lambda k: F.regexp_extract(in_address, rf"^(\d{{1,2}})({names})(\d{{2}})$", k)
        today = (in_address != "") & t.rlike(TODAY) & a(1).try_cast("int").between(1, 31)
        proxy = F.regexp_extract(s, rf"\b({names})(\d{{2}})\b", 0)
        of_address = F.when(proxy != "", F.struct(month(F.left(proxy, F.lit(3))).alias("m"), (F.lit(2000) + F.right(proxy, F.lit(2)).try_cast("int")).alias("y")))
        of_published = F.when(published.isNotNull(), F.struct(F.month(published).alias("m"), F.year(published).alias("y")))
        partial = F.when(t.rlike(END), first_valid(ends, r"\d{1,2}/\d{1,2}(?!/?\d)"))

        def full(d: Column) -> Column:
            return outcome("full_date", F.when(d[2] < 100, d[2] + 2000).otherwise(d[2]), d[1], d[0])

        def inferred(x: Column) -> Column:
            p, seen = x["p"], x["seen"]
            return F.when(seen.isNull(), outcome("no_year")).otherwise(outcome("year_inferred", seen["y"] + (p[1] < seen["m"]).cast("int"), p[1], p[0]))

        whole = first_valid(ends, r"\d{1,2}/\d{1,2}/\d{2,4}")
        return (
            F.when(t.rlike(NO_END), outcome("no_end_stated"))
            .when(today, outcome("address_and_today", F.lit(2000) + a(3).try_cast("int"), month(a(2)), a(1).try_cast("int")))
            .when(whole.isNotNull(), let(whole, full))
            .when(partial.isNotNull(), let(F.struct(partial.alias("p"), F.coalesce(of_address, of_published).alias("seen")), inferred))
            .otherwise(outcome("no_day_and_month"))
        )

    return F.coalesce(let(F.struct(unaccented(text).alias("t"), unaccented(address).alias("s")), of), none)


def tiered_bonus(text: Column) -> Column:
    """[(pct, audience)] in order: each "<n>% de bônus" or "bônus de <n>%", its audience named within 70 characters before and 40 after.

    A tier without audience goes where the same percentage has one that names it.
    """

    def of(parts: Column) -> Column:
        """parts: the text cut before each bonus, whose end is marked."""
        clean = lambda x: F.replace(x, F.lit("\x02"), F.lit(""))

        def tier(part: Column, i: Column) -> Column:
            before = F.right(clean(F.array_join(F.slice(parts, F.lit(1), i), "")), F.lit(BEFORE))
            bonus = F.split_part(part, F.lit("\x02"), F.lit(1))
            after = F.left(F.concat(F.split_part(part, F.lit("\x02"), F.lit(2)), clean(F.array_join(F.slice(parts, i + 2, F.size(parts)), ""))), F.lit(AFTER))
            context, audience = F.concat(before, bonus, after), F.lit(None).cast("string")
            for name, words in reversed(AUDIENCES):
                audience = F.when(context.rlike(words), name).otherwise(audience)
            return F.struct(F.regexp_extract(bonus, r"\d{1,3}", 0).cast("int").alias("pct"), audience.alias("audience"))

        tiers = F.transform(parts, lambda p, i: F.when(i > 0, tier(p, i)))
        return F.array_distinct(F.filter(tiers, lambda x: x.isNotNull() & x["pct"].between(1, 1000)))

    def specific(tiers: Column) -> Column:
        named = F.transform(F.filter(tiers, lambda x: x["audience"].isNotNull()), lambda x: x["pct"])
        return F.filter(tiers, lambda x: x["audience"].isNotNull() | ~F.array_contains(named, x["pct"]))

    marked = F.regexp_replace(F.translate(text, "\x01\x02", ""), BONUS, "\x01$0\x02")
    return let(let(F.split(marked, "\x01"), of), specific)
