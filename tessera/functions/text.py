"""Text expressions that stay within the JVM: tokenizers, n-grams of characters, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z0-9]+"
#: Where a compound word is parted: acronym before a capitalised word, small letter or digit before a capital, letter before digit, digit before letter.
PARTS = r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"

#: Control flow and literals that most languages share.
_FLOW = "if else for return import break continue true false".split()
_BRACES = [*_FLOW, *"switch case default const".split()]
_OBJECTS = [*_BRACES, *"while do try catch finally throw class extends new this super null void instanceof".split()]
_SCRIPT = [*_OBJECTS, *"function let var typeof in with undefined nan infinity export".split()]

#: Words of a language's syntax, which carry no meaning in a search.
STOP_WORDS = {
    "python": sorted({*_FLOW, *"def class self del pass raise with as from elif while try except finally and or not in is none".split()}),
    "go": sorted({*_BRACES, *"func package type struct interface map range nil var".split()}),
    "java": sorted({*_OBJECTS, *"package implements interface enum throws public private protected static final abstract native synchronized transient volatile strictfp assert goto".split(), *"boolean byte char short int long float double".split()}),
    "javascript": sorted(_SCRIPT),
    "typescript": sorted({*_SCRIPT, *"public private protected static readonly abstract override declare namespace module as asserts".split()}),
}


def _without(tokens: Column, stop_words: list[str] | None) -> Column:
    if not stop_words:
        return tokens
    stop = F.array(*[F.lit(w) for w in sorted(stop_words)])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, F.lower(t)))


def words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Runs of ASCII letters and digits."""
    return _without(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), stop_words)


def code_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words, each followed by its parts if it is a compound."""

    def expand(word: Column) -> Column:
        apart = F.split(F.regexp_replace(word, PARTS, " "), " ")
        return F.when(F.size(apart) > 1, F.concat(F.array(word), apart)).otherwise(F.array(word))

    return _without(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), expand)), stop_words)


#: Words that may be compounds: those with a capital or a digit that isn't the first character.
MAYBE_COMPOUND = r"(?<![A-Za-z0-9])([A-Za-z0-9][a-z]*+[A-Z0-9][A-Za-z0-9]*+)"


def lower_code_text(text: Column) -> Column:
    """code_tokens in lower case and with single spaces between: words first, then the parts of compounds.

    Only plain expressions on whole strings, no function of each word, so that
    generated code computes it once for all that a projection asks of it.
    """
    flat = F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))
    maybe = F.array_join(F.regexp_extract_all(flat, F.lit(MAYBE_COMPOUND), F.lit(1)), " ")
    apart = F.regexp_replace(maybe, PARTS, "\u0001")
    parts = F.array_join(F.regexp_extract_all(apart, F.lit("([A-Za-z0-9]+\u0001[^ ]*)"), F.lit(1)), " ")
    return F.lower(F.trim(F.concat(flat, F.lit(" "), F.translate(parts, "\u0001", " "))))


def lower_code_terms(text: Column) -> Column:
    """lower_code_text as a list."""
    return F.array_remove(F.split(lower_code_text(text), " "), "")


def plain_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """What white space separates: blanks, tabs, ends of lines and pages; Java's own class has vertical tabs besides."""
    return F.filter(F.split(text, r"[ \t\n\f\r]+"), lambda t: t != "")


TOKENIZERS = {"noop": plain_tokens, "word": words, "code": code_tokens}


def auto_tokens(text: Column, language: Column, tokenizer: str = "code") -> Column:
    """Tokens of a named tokenizer without the words of the row's language; a language without such words loses none."""
    quoted = lambda some: ", ".join(f"'{x}'" for x in some)
    stop = F.expr("map(" + ", ".join(f"'{name}', array({quoted(some)})" for name, some in STOP_WORDS.items()) + ")")
    mine = F.coalesce(F.try_element_at(stop, F.coalesce(language, F.lit(""))), F.array().cast("array<string>"))
    return F.filter(TOKENIZERS[tokenizer](text), lambda t: ~F.array_contains(mine, F.lower(t)))


def weighted_needle(fields: list[tuple[Column, int]], tokenizer=code_tokens, stop_words: list[str] | None = None) -> Column:
    """Tokens of all fields, those of a field as often as its weight says, joined by spaces. Null fields add nothing."""
    parts = [F.flatten(F.array_repeat(F.coalesce(tokenizer(c, stop_words), F.array().cast("array<string>")), n)) for c, n in fields if n > 0]
    return F.array_join(F.concat(*parts), " ")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; none if there are fewer."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def escape(char: str) -> str:
    """A character as itself in a pattern."""
    return char if char.isalnum() or char == "_" or ord(char) > 127 else "\\" + char


def subsequence(needle: str) -> str:
    """Pattern of texts that hold the needle's characters in order, whatever the case."""
    return "(?is)^.*" + ".*".join(escape(c) for c in needle) + ".*$"


def glob_pattern(glob: str) -> str:
    """Pattern of the texts that a shell glob matches; stars cross slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + (glob[i : i + 1] in ("!", "^"))
            j = glob.find("]", j + 1 if glob[j : j + 1] == "]" else j)
            if j < 0:
                out += "\\["
            else:
                inner = glob[i:j].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
                i = j + 1
        else:
            out += escape(c)
    return f"(?s)^(?:{out})$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def descriptiveness(name: Column) -> Column:
    """How much a name tells, 0 to 1: by its words (six are enough) and its length (thirty characters are)."""
    snake = F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_")
    n_words = F.size(F.filter(F.split(snake, "_"), lambda w: w != ""))
    score = F.round((F.least(n_words / F.lit(6.0), F.lit(1.0)) + F.least(F.length(name) / F.lit(30.0), F.lit(1.0))) / F.lit(2.0), 4)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(0.0)).otherwise(score)


def python_visibility(name: Column) -> Column:
    """Two underscores in front are private unless there are two behind, one is protected."""
    private = name.startswith("__") & ~name.endswith("__")
    return F.when(private, "private").when(name.startswith("_"), "protected").otherwise("public")


def go_visibility(name: Column) -> Column:
    """A capital in front is public."""
    return F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private")


def is_constant_name(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Z0-9_]*$")


def dotted_module(path: Column) -> Column:
    """Import name of a Python file; a package's own file stands for the package."""
    bare = F.regexp_replace(path, r"\.py$", "")
    return F.replace(F.regexp_replace(bare, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def language_of(path: Column, table: dict[str, str]) -> Column:
    """Language by the suffix, in lower case; null if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for ext, lang in table.items():
        out = F.when(suffix == ext, F.lit(lang)).otherwise(out)
    return out
