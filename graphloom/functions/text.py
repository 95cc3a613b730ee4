"""String functions as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_escapes(text: Column) -> Column:
    """$XXXX (four hex digits) becomes that character of the basic plane."""
    parts = F.split(text, r"\$(?=[0-9A-Fa-f]{4})")

    def one(part: Column, i: Column) -> Column:
        code = F.conv(F.substring(part, 1, 4), 16, 10).cast("int")
        # UTF-8 of a code point below 0x10000
        utf8 = F.when(code < 128, F.format_string("%02X", code)).when(code < 2048, F.format_string("%02X%02X", 192 + F.shiftright(code, 6), 128 + code.bitwiseAND(63))).otherwise(F.format_string("%02X%02X%02X", 224 + F.shiftright(code, 12), 128 + F.shiftright(code, 6).bitwiseAND(63), 128 + code.bitwiseAND(63)))
        return F.when(i == 0, part).otherwise(F.concat(F.unhex(utf8).cast("string"), F.substring(part, 5, 1 << 30)))

    return F.array_join(F.transform(parts, one), "")


def verbalise_relation(relation: Column, last: int | None) -> Column:
    """The last dotted parts of a relation (all for None) joined by spaces, underscores as spaces."""
    parts = F.split(relation, r"\.")
    kept = parts if last is None else F.slice(parts, F.greatest(F.size(parts) - last + 1, F.lit(1)), last)
    return F.translate(F.concat_ws(" ", kept), "_", " ")


def normalise_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation, articles and padding marks; white space squeezed."""
    text = F.replace(F.lower(text), F.lit("<pad>"), F.lit(" "))
    text = F.translate(text, string.punctuation, "")
    text = F.regexp_replace(text, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def answers_match(pred: Column, gold: Column) -> Column:
    """Whether the normalised gold occurs in the normalised prediction."""
    return F.contains(normalise_answer(pred), normalise_answer(gold))


def parse_answers(text: Column, separator: str) -> Column:
    """Non-empty trimmed parts of a separated list."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def answer_scores(pred: Column, gold: Column) -> dict[str, Column]:
    """precision, recall, f1, hit1 and hit of two string arrays by answers_match.

    Precision counts matched golds over predictions and so can exceed 1; f1 follows it.
    """
    matched = F.size(F.filter(gold, lambda g: F.exists(pred, lambda p: answers_match(p, g))))
    n, m = F.size(pred), F.size(gold)
    p = F.when(n > 0, matched / n).otherwise(0.0)
    r = F.when(m > 0, matched / m).otherwise(0.0)
    first = F.get(pred, F.lit(0))
    return {
        "precision": p, "recall": r, "f1": F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0),
        "hit1": F.coalesce(F.exists(gold, lambda g: answers_match(first, g)), F.lit(False)).cast("int"),
        "hit": (matched > 0).cast("int"),
    }


def strict_set_f1(pred: Column, gold: Column) -> Column:
    """F1 of the sets of normalised answers."""
    a, b = (F.array_distinct(F.transform(x, normalise_answer)) for x in (pred, gold))
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def spreadsheet_label(i: Column) -> Column:
    """Bijective base 26 of an index from 0 to 18277: A, ..., Z, AA, ..., ZZZ."""
    def letter(x):
        return F.chr((x + 65).cast("long"))

    two, three = i - 26, i - 702
    return F.when(i < 26, letter(i)).when(i < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, with 11th to 13th."""
    teen = (n % 100).between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def stable_seed(*parts: Column) -> Column:
    """First four bytes of the SHA-256 of the parts joined by ':', without the sign bit."""
    digest = F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def stable_token(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def align_up(value: Column, block: int) -> Column:
    return (F.ceil(value / block) * block).cast("long")


def bucket_pow2(value: Column, base: int = 128) -> Column:
    """The smallest of base * 2**i and base * 1.5 * 2**i that holds value."""
    blocks = F.greatest(F.ceil(value / base).cast("long"), F.lit(1).cast("long"))
    low = F.pow(F.lit(2.0), F.floor(F.log2(blocks.cast("double")))).cast("long")
    middle = F.floor(low * 3 / 2)
    pick = F.when(blocks == low, low).when((blocks <= middle) & (low > 1), middle).otherwise(low * 2)
    return (pick * base).cast("long")


def bucket_list(value: Column, sizes: list[int]) -> Column:
    """The smallest listed size that holds value; an error beyond the largest."""
    fits = F.array_min(F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= value))
    return F.coalesce(fits, F.raise_error(F.lit(f"a length exceeds the largest bucket {max(sizes)}")).cast("int"))


def size_text(n: Column) -> Column:
    """12345678 as 12M, 12345 as 12k."""
    return F.when(n >= 1_000_000, F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("M"))).when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def forecast_question(kind: str, key: Column, days: int) -> Column:
    """Will <kind> <key> order within <days> days?"""
    return F.format_string(f"Will {kind} %d order within {days} days?", key)


def yes_no(answer: Column) -> Column:
    return F.when(answer, "yes").otherwise("no")


def needle_sentence(name: Column, code: Column) -> Column:
    """The access code of <name> is <code>."""
    return F.concat(F.lit("The access code of "), name, F.lit(" is "), code.cast("string"), F.lit("."))


def chat_turn(role: Column, text: Column) -> Column:
    """A turn under its role's mark; a null text is empty."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce(text, F.lit("")))
