"""Language of a text by script, else by function words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import let

#: Blocks of scripts as code point ranges, fixed values; Latin letters are those below U+0250.
SCRIPTS = {
    "ja": "\\x{3040}-\\x{30FF}", "ko": "\\x{AC00}-\\x{D7A3}", "han": "\\x{4E00}-\\x{9FFF}", "cyr": "\\x{0400}-\\x{04FF}",
    "el": "\\x{0370}-\\x{03FF}", "ar": "\\x{0600}-\\x{06FF}", "hi": "\\x{0900}-\\x{097F}", "he": "\\x{0590}-\\x{05FF}", "th": "\\x{0E00}-\\x{0E7F}",
}
#: Frequent function words, fixed values; more languages can be given to detect().
FUNCTION_WORDS = {
    "en": "the of and to in a is that for on with as it was by are be at from this have not or an but has had who will",
    "es": "el la de que y en los las un una por con para no se su del al es lo como más pero sus le ya o",
    "fr": "le la les de des un une et en que qui dans pour pas sur au aux du est ne se ce il elle par plus avec",
    "de": "der die das und in den von zu mit ist im auf für dem nicht ein eine als auch sich wird bei aus nach werden",
    "it": "il lo la gli le di che e in un una per non con si sono come più ma anche della dei delle nel alla",
    "pt": "o a os as de que e do da em um uma para com não se por mais como mas dos das no na ao à",
}


def script_language(text: Column) -> Column:
    """The language that the text's script tells, null for Latin or fewer than 8 letters."""
    counts = F.struct(*[F.regexp_count(text, F.lit(f"[{v}]")).alias(k) for k, v in SCRIPTS.items()], F.regexp_count(text, F.lit("[\\p{L}&&[\\x{0000}-\\x{024F}]]")).alias("latin"))

    def told(n: Column) -> Column:
        letters = n["latin"]
        for k in SCRIPTS:
            letters = letters + n[k]
        out = F.when(letters < 8, None).when(n["ja"] > 0, "ja").when(n["ko"] > 0, "ko")
        out = out.when(n["cyr"] >= 0.3 * letters, F.when(text.rlike("[іїєґІЇЄҐ]"), "uk").otherwise("ru"))
        for lang in ("el", "ar", "hi", "he", "th"):
            out = out.when(n[lang] >= 0.3 * letters, lang)
        return out.when(n["han"] >= 0.2 * letters, "zh")

    # A text without any of these scripts needs no counts.
    return F.when(text.rlike("[" + "".join(SCRIPTS.values()) + "]"), let(counts, told))


def detect(text: Column, default: Column, function_words: dict[str, str] | None = None) -> Column:
    """Script, else the language with at least 3 function words and strictly most, else default."""
    text = F.btrim(F.coalesce(text, F.lit("")))
    tables = {k: v.split() for k, v in (function_words or FUNCTION_WORDS).items()}
    # Only words of some table count, so the others go at once.
    known = sorted({w for words in tables.values() for w in words})

    def by_words(x: Column) -> Column:
        held = lambda listed: F.size(F.filter(x["known"], lambda w: w.isin(*listed)))
        hits = F.array(*[F.struct(held(v).alias("n"), F.lit(-i).alias("place"), F.lit(k).alias("lang")) for i, (k, v) in enumerate(tables.items())])

        def clear(ranked: Column) -> Column:
            best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
            return F.when((x["size"] >= 4) & (best["n"] >= 3) & (best["n"] > F.coalesce(second["n"], F.lit(0))), best["lang"])

        return let(F.sort_array(hits, asc=False), clear)

    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))
    told = let(let(words, lambda w: F.struct(F.size(w).alias("size"), F.filter(w, lambda one: one.isin(*known)).alias("known"))), by_words)
    return F.when(text == "", default).otherwise(F.coalesce(script_language(text), told, default))
