"""Column functions on titles, slugs, names, tags and bodies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TITLE_STOPWORDS = (
    "a an the and or of in on at to for with from by as is are was were be it its this that has have will after over into amid says say said new now today here you"
).split()
CATEGORIES = ("models", "research", "industry", "funding", "regulation", "tools", "open-source", "opinion", "general")
CONCEPT_ENTITY_TYPES = ("org", "product", "model", "person", "paper")
GENERIC_CONCEPT_TAGS = ("", "ai", "llm", "general")
BRANDS = [
    "OpenAI", "ChatGPT", "DeepMind", "DeepSeek", "GitHub", "GitLab", "PyTorch", "TensorFlow", "LangChain", "LlamaIndex", "NVIDIA", "xAI", "OpenRouter", "vLLM", "SGLang", "arXiv", "YouTube", "LinkedIn", "TikTok", "iPhone",
    "iOS", "macOS", "Google DeepMind", "Hugging Face", "Meta AI", "Mistral AI", "Stability AI", "Scale AI",
]
ACRONYMS = (
    "AGI AI API APIs ASI CLI CNN CoT CPU CUDA EU GDPR GPT GPU GPUs HBM JAX KV LLM LLMs LoRA MCP ML MLOps MoE NLP OCR ONNX QLoRA RAG RL RLHF RNN SDK SLM SSM STT TPU TTS UI UK US UX VLM VRAM"
).split()

#: Word boundary as RE2 has it, on ASCII word characters only.
_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


#: What RE2 doesn't have: looking around, atomic groups, references back and possessive repeats.
_REFUSED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k[<{]|(?:[*+?]|\{\d+(?:,\d*)?\})\+")
#: Names of classes in brackets, as RE2 has them, in Spark's dialect.
_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "blank": "Blank", "xdigit": "XDigit", "cntrl": "Cntrl", "graph": "Graph", "print": "Print"}


def portable_regex(pattern: str, ignore_case: bool = True) -> str:
    """A pattern of the RE2 dialect for Spark's.

    ASCII word boundaries, ``$`` at the very end only, Unicode case folding, names of groups left out, scripts
    and bracketed classes under their names there. Quoted parts stay as they are.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("\\Q", i):
            end = pattern.find("\\E", i + 2)
            end = len(pattern) if end < 0 else end
            out.append(re.sub(r"([^0-9A-Za-z])", r"\\\1", pattern[i + 2 : end]))
            i = end + 2
            continue
        if c == "\\" and i + 1 < len(pattern):
            script = re.match(r"\\([pP])\{(\^?)([A-Z][a-z]{2,}\w*)\}", pattern[i:])
            if script:
                out.append(f"\\{script[1]}{{{script[2]}Is{script[3]}}}")
                i += len(script[0])
                continue
            out.append(_BOUNDARY if pattern[i + 1] == "b" and not in_class else pattern[i : i + 2])
            i += 2
            continue
        named = re.match(r"\(\?P?<\w+>", pattern[i:])
        if named and not in_class:
            out.append("(?:")
            i += len(named[0])
            continue
        if in_class:
            posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
            if posix and (posix[2] in _POSIX or posix[2] == "word"):
                name = r"\w" if posix[2] == "word" else rf"\p{{{_POSIX[posix[2]]}}}"
                out.append(name[0] + name[1].upper() + name[2:] if posix[1] else name)
                i += len(posix[0])
                continue
            in_class = c != "]"
            if c == "[" or pattern.startswith("&&", i):
                out.append("\\")  # plain characters in RE2's classes
        elif c == "[":
            in_class = True
            first = re.match(r"\[\^?\]?", pattern[i:])[0]
            out.append(first.replace("]", r"\]"))
            i += len(first)
            continue
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def re2_has(pattern: str) -> bool:
    """Whether a pattern holds nothing that RE2 refuses; quoted parts and classes may hold anything."""
    bare = re.sub(r"\\Q.*?(?:\\E|\Z)", "", pattern, flags=re.S)
    return not _REFUSED.search(re.sub(r"\\\\|\[\^?\]?(?:\\.|[^\]\\])*\]", "x", bare))


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def simhash_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)


def title_tokens(title: Column) -> Column:
    """Words of a headline in order, repeats kept; stop words go before dots and hyphens at word ends do."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"([a-z0-9][a-z0-9.\-]*)"))
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    return F.transform(kept, lambda w: F.regexp_replace(w, r"[.\-]+$", ""))


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def versions_agree(a: Column, b: Column) -> Column:
    """Whether tokens with digits share one, or one side has none."""
    va, vb = (F.filter(x, lambda t: t.rlike("[0-9]")) for x in (a, b))
    return (F.size(va) == 0) | (F.size(vb) == 0) | F.arrays_overlap(va, vb)


def same_story(a: Column, b: Column, shared: int = 4, similarity: float = 0.55) -> Column:
    return (shared_tokens(a, b) >= shared) & versions_agree(a, b) & (title_similarity(a, b) >= similarity)


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(trimmed(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(dashed, 1, 80), "^-+|-+$", ""), F.lit("")), F.lit("note"))


def strip_brackets(text: Column) -> Column:
    return trimmed(F.replace(F.replace(text, F.lit("[[")), F.lit("]]")))


def canon_key(slug: Column) -> Column:
    return F.replace(F.regexp_replace(slug, r"-concept(-[0-9]+)?$", ""), F.lit("-"))


def _lookup(keys: list[str], values: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.array_position(F.array(*[F.lit(k) for k in keys]), key).cast("int") - 1)


def display_name(raw: Column) -> Column:
    """How a reader should see a concept: mixed case is kept, then brands, then acronyms and capitals; a number is joined by a hyphen."""
    s = trimmed(raw)
    brand = _lookup([b.lower().replace(" ", "") for b in BRANDS], BRANDS, canon_key(slugify(s)))
    tokens = F.filter(F.split(s, "[-_ ]"), lambda t: t != "")

    def cased(t: Column) -> Column:
        return F.coalesce(_lookup([a.lower() for a in ACRONYMS], ACRONYMS, t), F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))

    joined = F.aggregate(tokens, F.lit(""), lambda a, t: F.when(a == "", cased(t)).when(t.rlike(r"^\p{Nd}+$"), F.concat(a, F.lit("-"), cased(t))).otherwise(F.concat(a, F.lit(" "), cased(t))))
    return F.when((s == "") | (F.lower(s) != s), s).otherwise(F.coalesce(brand, F.when(F.size(tokens) == 0, s).otherwise(joined)))


def concept_slugs(entities: Column, tags: Column) -> Column:
    """Slugs of an article's concept entities and of its tags that aren't generic, sorted, each once."""
    own = F.transform(F.filter(entities, lambda e: F.lower(e["type"]).isin(*CONCEPT_ENTITY_TYPES)), lambda e: slugify(e["name"]))
    return F.array_sort(F.array_distinct(F.concat(own, tag_slugs(tags))))


def tag_slugs(tags: Column) -> Column:
    lowered = F.transform(tags, lambda t: F.lower(trimmed(t)))
    return F.transform(F.filter(lowered, lambda t: ~t.isin(*GENERIC_CONCEPT_TAGS)), slugify)


def concept_name(entities: Column, tags: Column, slug: Column) -> Column:
    """The display name of the first entity, else tag, that has the slug; else of the slug."""
    entity = F.get(F.filter(entities, lambda e: slugify(e["name"]) == slug), F.lit(0))["name"]
    tag = F.get(F.filter(tags, lambda t: slugify(t) == slug), F.lit(0))
    return display_name(F.coalesce(entity, tag, slug))


def domain_pattern(url: Column) -> Column:
    """Host of a source url with dots escaped, for use in a rule."""
    return F.replace(F.regexp_extract(F.regexp_replace(url, "^https?://(?=.)", ""), "^([^/?]*)", 1), F.lit("."), F.lit("\\."))


def snippet(text: Column, n: int = 220) -> Column:
    return excerpt(F.regexp_replace(text, r"\s+", " "), n)


def excerpt(text: Column, n: int = 600) -> Column:
    """Trimmed and cut after n characters."""
    t = trimmed(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(" …"))).otherwise(t)


def embed_text(title: Column, body: Column, n: int = 1200) -> Column:
    t, b = trimmed(title), F.substring(trimmed(body), 1, n)
    return F.when(t == "", b).otherwise(F.concat(t, F.lit("\n\n"), b))


def note_day(content: Column, created_at: Column) -> Column:
    """The day a note is about: what its head says under ``created``, else when it was made."""
    head = F.regexp_extract(F.coalesce(content, F.lit("")), r"(?s)\A---\n(.*?\n)---\n", 1)
    said = F.regexp_extract(head, r"""(?m)^created:\s*["']?(\d{4}-\d{2}-\d{2})""", 1)
    return F.coalesce(F.nullif(said, F.lit("")).try_cast("date"), F.to_date(created_at))


def content_key(name: Column, slugs: Column) -> Column:
    """Cache key of a name and the slugs it rests on."""
    return F.sha2(F.concat(name, F.lit("\0"), F.array_join(F.array_sort(slugs), "\0")), 256)


def sanitize_category(category: Column) -> Column:
    c = F.lower(trimmed(F.coalesce(category, F.lit(""))))
    return F.when(c.isin(*CATEGORIES), c).otherwise("general")


def dedupe_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(trimmed(t))), lambda t: t != ""))


def clamp_importance(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), value))


def parse_wikilinks(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)")), trimmed)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def note_body(text: Column) -> Column:
    """A note without its frontmatter block."""
    end = F.locate("\n---\n", text, 4)
    return F.when(F.startswith(text, F.lit("---\n")) & (end > 0), F.substr(text, end + 5)).otherwise(text)


def split_frontmatter(text: Column) -> Column:
    """(frontmatter, body); without a closed block the frontmatter is empty."""
    end = F.locate("\n---\n", text, 4)
    has = F.startswith(text, F.lit("---\n")) & (end > 0)
    return F.struct(F.when(has, F.substr(text, F.lit(5), F.greatest(end - 5, F.lit(0)))).otherwise("").alias("frontmatter"), note_body(text).alias("body"))


def parse_tags(frontmatter: Column) -> Column:
    """Items of the ``tags`` list of a frontmatter, unquoted."""
    block = F.regexp_extract(frontmatter, r"(?m)^tags:[ \t]*\n((?:[ \t]+- .*(?:\n|\z))*)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+- (.*)$")), lambda t: F.regexp_replace(trimmed(t), r"""^["']|["']$""", ""))


def parse_title(frontmatter: Column, body: Column, path: Column) -> Column:
    """First heading, else the frontmatter's title, else the file's stem."""
    heading = trimmed(F.regexp_extract(body, r"(?m)^# (.+)$", 1))
    own = F.regexp_replace(trimmed(F.regexp_extract(frontmatter, r"(?m)^title:[ \t]*(.*)$", 1)), r"""^["']|["']$""", "")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(own, F.lit("")), stem)


def extract_links(markdown: Column) -> Column:
    """Links of a markdown text as structs (text, url): labelled ones, then bare ones; images out, the first of each url kept."""
    named = F.regexp_extract_all(markdown, F.lit(r"(\[[^\]]*\]\(https?://[^\s)]+\))"))
    pairs = F.transform(named, lambda m: F.struct(F.regexp_extract(m, r"^\[([^\]]*)\]", 1).alias("text"), F.regexp_extract(m, r"\((https?://[^\s)]+)\)$", 1).alias("url")))
    bare = F.transform(F.regexp_extract_all(markdown, F.lit(r"""(?:^|[^(\]"'=])(https?://[^\s)<>"'\]]+)""")), lambda u: F.struct(u.alias("text"), F.regexp_replace(u, r"[.,;:!?]+$", "").alias("url")))
    every = F.filter(F.concat(pairs, bare), lambda x: ~x["url"].rlike(r"(?i)\.(png|jpe?g|gif|webp|svg|avif|ico)(\?|$)"))
    first = F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["url"]), x["url"]) == i + 1)
    return F.transform(first, lambda x: F.struct(F.coalesce(F.nullif(x["text"], F.lit("")), x["url"]).alias("text"), x["url"].alias("url")))
