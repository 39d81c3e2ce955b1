"""Caption and label texts: nouns, clauses, verb forms, slugs, presets, redaction, scrubbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Words that a noun phrase stands between, and words that are no nouns.
ANCHORS = (
    "a an the of with on in at into from onto over under beside near behind through against between toward towards along across around above below beneath inside outside past"
).split()
NON_NOUNS = (
    "is are was were be being been has have had and or but as by to for that this these those it its their his her him she he they them which while when where "
    "time moment scene shot video camera frame atmosphere mood expression setting presence sense view focus detail feeling "
    "set feature part side top front back piece kind amount "
    "sunlit cozy domestic natural tranquil ongoing focused wooden glass orange snowy striped narrow distant bright dark soft"
).split()
ENDINGS = ("ing", "ed", "ion", "ness", "ly")


def singular(word: Column) -> Column:
    """ies to y in words of more than four letters, else a last s off words of more than three, unless they end in ss, us or
    is."""
    ies = word.endswith("ies") & (F.length(word) > 4)
    keeps = word.endswith("ss") | word.endswith("us") | word.endswith("is") | ~word.endswith("s") | (F.length(word) <= 3)
    return F.when(ies, F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y"))).when(keeps, word).otherwise(F.substring(word, F.lit(1), F.length(word) - 1))


def nouns(prompt: Column) -> Column:
    """The heads of a prompt's noun phrases, singular, in order, without repeats: words that aren't anchors or listed
    non-nouns and that an anchor, or the end of the prompt, follows. Heads that are non-nouns in the singular, have fewer
    than three letters or an ending of verbs, adverbs and abstract nouns go. Null for null."""
    among = lambda w, words: F.array_contains(F.array(*map(F.lit, words)), w)
    words = F.regexp_extract_all(F.lower(prompt), F.lit("[a-z]+"), F.lit(0))

    def heads(ws):
        ends = lambda i: F.coalesce(among(F.get(ws, i + 1), ANCHORS), F.lit(True))
        at = F.filter(F.transform(ws, lambda w, i: F.when(~among(w, [*ANCHORS, *NON_NOUNS]) & ends(i), singular(w))), lambda w: w.isNotNull())
        bad = lambda w: among(w, NON_NOUNS) | (F.length(w) <= 2) | F.exists(F.array(*map(F.lit, ENDINGS)), lambda e: w.endswith(e))
        return F.array_distinct(F.filter(at, lambda w: ~bad(w)))

    return F.element_at(F.transform(F.array(words), heads), 1)


def sentence(parts: list[Column]) -> Column:
    """The parts that are not null or blank, joined by commas, with a capital and a full stop; empty without any."""
    kept = F.filter(F.array(*[F.trim(p) for p in parts]), lambda x: x.isNotNull() & (x != ""))
    text = F.array_join(kept, ", ")
    return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30), F.lit(".")))


def framing_kept(clause: Column, in_frame: Column, least: float) -> Column:
    """The clause, but null where the measured share in frame is below least; a missing share never drops it."""
    return F.when(~F.coalesce(in_frame < least, F.lit(False)), clause)


def shortened(text: Column, most: int) -> Column:
    """The first words of a text that together have at most so many characters, without a trailing comma."""
    cut = F.regexp_extract(F.substring(text, 1, most + 1), r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(cut, r"[,;:]+$", ""))


def _by_table(verb: Column, table: dict[str, str], rule: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), verb), rule)


def third_person(verb: Column, irregular: dict[str, str]) -> Column:
    rule = F.when(verb.rlike("(s|x|ch|sh|o)$"), F.concat(verb, F.lit("es"))).when(verb.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(verb, "y$", "i"), F.lit("es"))).otherwise(F.concat(verb, F.lit("s")))
    return _by_table(verb, irregular, rule)


def gerund(verb: Column, irregular: dict[str, str]) -> Column:
    rule = F.when(verb.rlike("[^eoy]e$"), F.concat(F.regexp_replace(verb, "e$", ""), F.lit("ing"))).otherwise(F.concat(verb, F.lit("ing")))
    return _by_table(verb, irregular, rule)


def slug(*labels: Column) -> Column:
    """Labels in lower case with signs as underscores, joined by two of them."""
    return F.concat_ws("__", *[F.regexp_replace(F.regexp_replace(F.lower(l), "[^a-z0-9]+", "_"), "^_+|_+$", "") for l in labels])


def slot(label: Column, words: dict[str, list[str]], default: str) -> Column:
    """The first slot one of whose words the label contains."""
    low = F.lower(label)
    out = F.lit(default)
    for name, listed in reversed(list(words.items())):
        hit = F.lit(False)
        for w in listed:
            hit = hit | F.coalesce(low.contains(w), F.lit(False))
        out = F.when(hit, name).otherwise(out)
    return out


def preset(name: Column, legacy: dict[str, str], aim: Column) -> Column:
    """The canonical name of a preset; one that looks at its subject gets the suffix of its aim."""
    table = F.create_map(*[F.lit(x) for p in legacy.items() for x in p])
    plain = F.coalesce(F.try_element_at(table, name), name)
    return F.when(aim == "look_at", F.concat(plain, F.lit("_aimed"))).otherwise(plain)


def redacted(prompt: Column, words: list[str]) -> Column:
    """Listed words, between what are no letters, digits or underscores of any script, become [removed] and numbers a hash
    sign."""
    word = r"[\p{L}\p{N}_]"
    return F.regexp_replace(F.regexp_replace(prompt, rf"(?i)(?<!{word})(?:{'|'.join(words)})(?!{word})", "[removed]"), r"[0-9]+(?:\.[0-9]+)?", "#")


def flipped(prompt: Column) -> Column:
    """left and right, up and down change places, words kept whole."""
    pairs = (("left", "right"), ("up", "down"))
    out = prompt
    for a, b in pairs:
        out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, rf"\b{a}\b", "\u0001"), rf"\b{b}\b", a), "\u0001", b)
    return out


def content_words(text: Column, stopwords: list[str], fallback: str) -> Column:
    """The words that are no stop words, without repeats; the fallback phrase where none is left."""
    kept = F.array_except(F.filter(F.split(F.lower(text), r"[^a-z]+"), lambda x: x != ""), F.array(*[F.lit(w) for w in stopwords]))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(fallback)


def segment_text(segment: Column, moves: list[str], turns: list[str]) -> Column:
    """The words of class move * len(turns) + turn; null beyond the classes."""
    listed = lambda xs, i: F.try_element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    move, turn = listed(moves, F.floor(segment / len(turns))), listed(turns, F.pmod(segment, F.lit(len(turns))))
    return F.when((segment >= 0) & move.isNotNull(), F.concat_ws(" and ", move, turn))


def stem(name: Column) -> Column:
    """An object's group: its name without numbers and a plural s."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[_ .]*[0-9]+$", ""), "([^s])s$", "$1")


def clauses(moves: Column, target: Column) -> Column:
    """A sentence from a list of moves: toward the target after a move in, from it after a move out, then the others."""
    first = F.element_at(moves, 1)
    where = F.when(first == "in", F.concat(F.lit(" toward "), target)).when(first == "out", F.concat(F.lit(" from "), target)).otherwise("")
    rest = F.transform(F.slice(moves, F.lit(2), F.greatest(F.size(moves) - 1, F.lit(0))), lambda m: F.concat(F.lit(", then "), m))
    return F.when(F.size(moves) > 0, F.concat(F.lit("moves "), first, where, F.array_join(rest, "")))


def fingerprint(*values: Column) -> Column:
    """Eight hex digits of sha1 of the values, nulls apart from blanks."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("~")) for v in values]).cast("binary")), 1, 8)
