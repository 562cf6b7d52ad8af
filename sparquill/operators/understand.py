"""What a query asks for: kind, intent, complexity, rewriting and parts. Row-wise over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

# Abbreviations and what they stand for, in the order they are replaced.
ABBREVIATIONS = (
    ("ML", "machine learning"), ("AI", "artificial intelligence"), ("NLP", "natural language processing"), ("API", "application programming interface"), ("UI", "user interface"), ("UX", "user experience"),
)
# Spellings put right as whole words.
SPELLINGS = (("teh", "the"), ("adn", "and"), ("wat", "what"))
WH_WORDS = ("what", "how", "why", "when", "where", "who", "which")
CONNECTORS = (" and ", " or ", " but ", " also ")


def kind(q: Column) -> Column:
    """question, keyword, phrase or statement."""
    n = F.size(words(q))
    return F.when(F.contains(q, F.lit("?")), "question").when(n <= 3, "keyword").when(n > 10, "phrase").otherwise("statement")


def complexity(q: Column) -> Column:
    """Of length, question words, connectors and question marks; 1 at most."""
    low = F.lower(q)
    tokens = words(low)
    count = lambda xs, of: F.size(F.filter(of, lambda t: t.isin(*xs)))
    marks = F.char_length(q) - F.char_length(F.replace(q, F.lit("?"), F.lit("")))
    return F.least(
        F.lit(1.0),
        0.3 * F.least(F.size(tokens) / 20, F.lit(1.0)) + F.least(0.1 * count(WH_WORDS, tokens), F.lit(0.3)) + F.least(0.15 * count(tuple(c.strip() for c in CONNECTORS), tokens), F.lit(0.3)) + F.when(marks > 1, 0.2).otherwise(0.0),
    )


def spelled(q: Column) -> Column:
    """The first of SPELLINGS that the query has, put right."""
    out = F.when(F.lit(False), q)
    for wrong, right in SPELLINGS:
        out = out.when(q.rlike(f"\\b{wrong}\\b"), F.regexp_replace(q, f"\\b{wrong}\\b", right))
    return out.otherwise(q)


def rewritten(q: Column) -> Column:
    """Spelling, marks and spaces put right, abbreviations spelled out, a capital ahead."""
    out = spelled(q)
    for short, long in ABBREVIATIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    out = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "!+", "!"), "\\?+", "?"), " +", " "))
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.char_length(out)))


def template(q: Column) -> Column:
    """Whole numbers and quoted strings as placeholders."""
    return F.regexp_replace(F.regexp_replace(q, "\\b[0-9]+\\b", "{NUM}"), '"[^"]*"', "{STR}")


def understand(queries: DataFrame, id_columns: list[str], text: str = "text") -> DataFrame:
    q = F.col(text)
    return queries.select(*id_columns, kind(q).alias("kind"), F.round(complexity(q), 6).alias("complexity"), F.md5(rewritten(q)).alias("rewritten"), F.md5(template(q)).alias("template"))


def parts(queries: DataFrame, id_columns: list[str], text: str = "text", most: int = 5) -> DataFrame:
    """Sub-queries of a query at its connectors, in order, `most` at most: the operator's own bound."""
    cut = F.slice(F.filter(F.transform(F.split(F.lower(F.col(text)), "|".join(CONNECTORS)), lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    return queries.select(*id_columns, F.posexplode(cut).alias("part", "sub_query")).select(*id_columns, F.col("part").cast("long").alias("part"), F.md5("sub_query").alias("sub_query"))


# Intents with their keywords (within a word), phrases and confidence, in order.
INTENTS = (
    ("definitional", ("define", "definition", "meaning"), ("what is", "what does", "define"), 0.9),
    ("procedural", ("how", "step", "tutorial", "guide"), ("how to", "step by step", "how do i"), 0.9),
    ("comparative", ("compare", "difference", "better", "versus"), ("vs", "compared to", "difference between"), 0.8),
    ("troubleshooting", ("problem", "error", "fix", "issue", "broken"), ("not working", "how to fix", "troubleshoot"), 0.8),
    ("factual", ("when", "where", "who", "which"), ("when did", "where is", "who created"), 0.7),
)
# Domains with their words, in order.
DOMAINS = (
    ("technology", ("code", "programming", "software", "api", "database", "algorithm", "computer")), ("science", ("research", "study", "experiment", "theory", "analysis", "data", "scientific")),
    ("business", ("market", "sales", "revenue", "customer", "profit", "strategy", "management")), ("health", ("medical", "health", "disease", "treatment", "doctor", "medicine", "patient")),
    ("education", ("learn", "study", "school", "university", "course", "education", "teach")),
)
# Words by which a query leans on what was said before.
CONTEXT_WORDS = ("this", "that", "it", "they", "them", "previous", "above", "following", "these", "those")
# Technical terms that queries name.
TECH_TERMS = ("api", "sql", "json", "html", "css", "javascript", "python", "rust", "docker")
# Synonyms, the first three of which a query is widened by.
SYNONYMS = (
    ("fast", ("quick", "rapid", "speedy")), ("big", ("large", "huge", "massive")), ("small", ("tiny", "little", "compact")), ("good", ("excellent", "great", "quality")), ("bad", ("poor", "terrible", "awful")),
    ("simple", ("easy", "basic", "straightforward")), ("difficult", ("hard", "challenging", "complex")), ("method", ("approach", "technique", "way")), ("create", ("build", "make", "develop")), ("use", ("utilize", "employ", "apply")),
)


def _any(tokens: Column, part: str) -> Column:
    return F.exists(tokens, lambda t: F.contains(t, F.lit(part)))


def intent_scores(q: Column) -> Column:
    """Intents and their scores: a point for each keyword and two for each phrase, by their number, times the confidence."""
    low = F.lower(q)
    tokens = words(low)
    out = []
    for name, keys, phrases, confidence in INTENTS:
        points = sum((_any(tokens, k).cast("int") for k in keys), F.lit(0)) + sum((2 * F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))
        out.append(F.struct((points / (len(keys) + len(phrases)) * confidence).alias("score"), F.lit(-len(out)).alias("place"), F.lit(name).alias("name")))
    return F.array(*out)


def domain(q: Column) -> Column:
    """The first domain with two words in the query, or one in a query of five words at most; null without."""
    tokens = words(F.lower(q))
    out = F.when(F.lit(False), "")
    for name, keys in DOMAINS:
        n = sum((_any(tokens, k).cast("int") for k in keys), F.lit(0))
        out = out.when((n >= 2) | ((n == 1) & (F.size(tokens) <= 5)), name)
    return out


def needs_context(q: Column) -> Column:
    tokens = words(F.lower(q))
    return F.arrays_overlap(tokens, F.array(*map(F.lit, CONTEXT_WORDS))) | (F.size(tokens) <= 2)


def is_vague(q: Column) -> Column:
    low = F.lower(q)
    return low.rlike(r"^(what|how|why|when|where)\s+is\s+\w+\?*$") | low.rlike(r"^(tell me about|about|info on)\s+\w+\?*$") | low.rlike(r"^\w{1,3}\?*$")


def clarified(q: Column) -> Column:
    """A plainer question for what starts in a known way; null for others."""
    low = F.lower(q)
    bare = F.regexp_replace(q, r"\?+$", "")
    return F.when(F.startswith(low, F.lit("what is")), F.concat(bare, F.lit(" and how does it work?"))).when(F.startswith(low, F.lit("how")), F.concat(bare, F.lit(" step by step"))).when(F.startswith(low, F.lit("tell me about")), F.replace(low, F.lit("tell me about"), F.lit("explain the concept of")))


def intent(q: Column) -> Column:
    """(name, score) of a query's intent: the best by score; below 0.3 what its first words or a comparing one say, at 0.6; factual if nothing speaks."""
    low, best = F.lower(q), F.array_max(intent_scores(q))
    found = lambda name, score: F.struct(F.lit(name).alias("name"), F.lit(score).alias("score"))
    return (
        F.when(best["score"] >= 0.3, F.struct(best["name"].alias("name"), best["score"].alias("score")))
        .when(F.startswith(low, F.lit("what is")) | F.startswith(low, F.lit("define")), found("definitional", 0.6))
        .when(F.startswith(low, F.lit("how to")) | F.contains(low, F.lit("step")), found("procedural", 0.6))
        .when(F.contains(low, F.lit("compare")) | F.contains(low, F.lit("vs")) | F.contains(low, F.lit("difference")), found("comparative", 0.6))
        .when(best["score"] > 0, F.struct(best["name"].alias("name"), best["score"].alias("score")))
        .otherwise(found("factual", 0.0))
    )


def classified(queries: DataFrame, id_columns: list[str], text: str = "text") -> DataFrame:
    """Intent and its score, domain, technical terms, and whether a query leans on others or is vague."""
    q = F.col(text)
    tech = F.filter(words(F.lower(q)), lambda t: t.isin(*TECH_TERMS))
    return queries.withColumn("__intent", intent(q)).select(
        *id_columns, F.col("__intent.name").alias("intent"), F.round("__intent.score", 6).alias("intent_score"), domain(q).alias("domain"), F.array_join(tech, " ").alias("entities"),
        needs_context(q).alias("needs_context"), is_vague(q).alias("vague"), F.md5(clarified(q)).alias("clarified"),
    )


def characteristics(queries: DataFrame, id_columns: list[str], text: str = "text", base: float = 0.6) -> DataFrame:
    """Words, marks of a question, of names and of technical terms, complexity, and the weight that vector search gets."""
    q = F.col(text)
    tokens = words(q)
    x = queries.select(
        *id_columns, F.size(tokens).alias("n"), (F.contains(q, F.lit("?")) | q.rlike("^(what|how|why|when|where|who)")).alias("question"), F.exists(tokens, lambda t: t.rlike("^\\p{Lu}")).alias("names"),
        F.exists(tokens, lambda t: F.lower(t).isin("algorithm", "function", "method", "system", "protocol", "framework")).alias("technical"),
    )
    complexity = F.least(F.col("n") / 10, F.lit(1.0))
    weight = base + F.when(F.col("question"), 0.1).otherwise(0.0) - F.when(F.col("names"), 0.1).otherwise(0.0) - F.when(F.col("technical"), 0.05).otherwise(0.0) + 0.1 * complexity
    return x.select(*id_columns, "n", "question", "names", "technical", F.round(complexity, 6).alias("complexity"), F.round(F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)), 6).alias("weight"))


def expanded(queries: DataFrame, dictionary: DataFrame, id_columns: list[str], text: str = "text", most: int = 3) -> DataFrame:
    """(ids, term, added) for the words of queries that a dictionary (term, place, added) widens, but what the query has already."""
    x = queries.select(*id_columns, F.filter(F.transform(words(F.lower(F.col(text))), lambda t: F.regexp_replace(t, "^[^a-z0-9]+|[^a-z0-9]+$", "")), lambda t: F.octet_length(t) > 2).alias("t"))
    each = x.select(*id_columns, "t", F.explode(F.array_distinct("t")).alias("term")).join(F.broadcast(dictionary.where(F.col("place") < most)), "term")  # a list of literals
    return each.where(~F.array_contains("t", F.col("added"))).select(*id_columns, "term", "added")


def topics(queries: DataFrame, id_columns: list[str], text: str = "text") -> DataFrame:
    """A question for each capitalised word of three bytes or more but the last, where a query has more than one."""
    w = words(F.col(text))
    found = F.array_sort(F.array_distinct(F.filter(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda t: t.rlike("^\\p{Lu}") & (F.octet_length(t) > 2))))
    x = queries.select(*id_columns, found.alias("t")).where(F.size("t") > 1)
    return x.select(*id_columns, F.posexplode("t").alias("place", "topic")).select(*id_columns, F.col("place").cast("long").alias("place"), F.concat(F.lit("What is "), "topic", F.lit("?")).alias("question"))


# Words that are no subject, and words that are no noun.
NO_SUBJECT = ("what", "when", "where", "how", "why", "who", "the", "and")
NO_NOUN = ("the", "and", "or", "of", "in", "on", "at")
# Words that carry no term, for answers made up beforehand.
NO_TERM = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "can", "what", "how", "why", "when", "where", "who", "which",
)
# Domains of answers with the parts of a query that name them, in order.
ANSWER_DOMAINS = (
    ("technology", ("code", "programming", "software", "api", "database", "algorithm", "computer", "tech")), ("science", ("research", "study", "experiment", "theory", "analysis", "scientific", "hypothesis")),
    ("business", ("market", "sales", "revenue", "customer", "profit", "strategy", "management", "company")), ("health", ("medical", "health", "disease", "treatment", "doctor", "medicine", "patient", "healthcare")),
    ("education", ("learn", "study", "school", "university", "course", "education", "teach", "academic")), ("finance", ("money", "investment", "financial", "bank", "trading", "economics", "cost", "price")),
)


def _bare(word: Column) -> Column:
    """word without what is neither letter nor digit at its ends."""
    return F.regexp_replace(word, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")


def subject(q: Column) -> Column:
    """The first word of more than three bytes that may be a subject, or "this"."""
    found = F.filter(words(q), lambda t: (F.octet_length(t) > 3) & ~F.lower(t).isin(*NO_SUBJECT))
    return F.coalesce(_bare(F.get(found, F.lit(0))), F.lit("this"))


def _noun(text: Column, last: bool) -> Column:
    found = F.filter(words(text), lambda t: (F.octet_length(t) > 2) & ~F.lower(t).isin(*NO_NOUN))
    return F.coalesce(F.get(F.reverse(found) if last else found, F.lit(0)), text)


def compared(q: Column) -> Column:
    """What a query compares: the nouns around " vs ", or the first two words after "compare"."""
    low = F.lower(q)
    at = F.instr(low, " vs ")
    before, after = F.trim(F.substring(q, F.lit(1), at - 1)), F.trim(F.substring(q, at + 4, F.char_length(q)))
    tokens = words(q)
    place = F.array_position(F.transform(tokens, F.lower), "compare").cast("int")
    rest = F.filter(F.slice(tokens, place + 1, F.size(tokens)), lambda t: (F.octet_length(t) > 2) & ~F.lower(t).isin("compare", "and", "with", "to"))
    return F.when(at > 0, F.array(_noun(before, True), _noun(after, False))).when(place > 0, F.transform(F.slice(rest, 1, 2), _bare)).otherwise(F.array().cast("array<string>"))


def answer_kind(q: Column) -> Column:
    """What an answer to a question is like, by how the question starts."""
    low = F.lower(q)
    starts = lambda *heads: low.rlike("^(" + "|".join(heads) + ")")
    return (
        F.when(starts("what is", "define"), "definitional").when(starts("how"), "procedural").when(starts("when"), "temporal").when(starts("where"), "locational").when(starts("why"), "causal")
        .when(low.rlike("compare|vs"), "comparative").otherwise("factual")
    )


def decomposed(queries: DataFrame, id_columns: list[str], text: str = "text") -> DataFrame:
    """(ids, strategy, place, question, confidence, priority, answer): questions on time and on what a query compares."""
    q = F.col(text)
    x = queries.select(*id_columns, F.lower(q).alias("low"), subject(q).alias("s"), compared(q).alias("c"))
    part = lambda strategy, question, confidence, priority: F.struct(F.lit(strategy).alias("strategy"), question.alias("question"), F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority"))
    ask = lambda cue, question: F.when(F.contains("low", F.lit(cue)), part("temporal", question, 0.7, 0.8))
    times = F.filter(F.array(ask("when", F.format_string("When did %s happen?", "s")), ask("before", F.format_string("What happened before %s?", "s")), ask("after", F.format_string("What happened after %s?", "s"))), lambda e: e.isNotNull())
    each = F.transform("c", lambda item: part("comparative", F.concat(F.lit("What are the features of "), item, F.lit("?")), 0.75, 0.8))
    both = F.concat(each, F.array(part("comparative", F.concat(F.lit("Compare "), F.get("c", F.lit(0)), F.lit(" and "), F.get("c", F.lit(1))), 0.9, 1.0)))
    found = F.concat(times, F.when(F.size("c") >= 2, both).otherwise(F.slice(both, 1, 0)))
    return x.select(*id_columns, F.posexplode(found).alias("place", "e")).select(*id_columns, "e.strategy", F.col("place").cast("long").alias("place"), "e.question", "e.confidence", "e.priority", answer_kind(F.col("e.question")).alias("answer"))


def key_terms(q: Column) -> Column:
    """Words of three bytes or more that carry a term, bare."""
    return F.filter(F.transform(words(q), _bare), lambda t: (F.octet_length(t) > 2) & ~F.lower(t).isin(*NO_TERM))


def answer_type(q: Column) -> Column:
    low = F.lower(q)
    return (
        F.when(low.rlike("^(what is|define)"), "definitional").when(low.rlike("^how to|step"), "procedural").when(low.rlike("compare|vs|difference"), "comparative").when(low.rlike("^(when|where|who)"), "factual")
        .when(low.rlike("^why"), "causal").when(low.rlike("^list|examples"), "enumerative").otherwise("general")
    )


def answer_domain(q: Column) -> Column:
    """The first domain with two of its parts in the query, or one in a query of five words at most; null without."""
    low, out = F.lower(q), F.when(F.lit(False), "")
    for name, keys in ANSWER_DOMAINS:
        n = sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0))
        out = out.when((n >= 2) | ((n == 1) & (F.size(words(low)) <= 5)), name)
    return out


def answer_confidence(pairs: DataFrame, id_columns: list[str], low: int = 50, high: int = 500) -> DataFrame:
    """(ids, type, domain, subject, n_terms, confidence) of answers made up for queries: their length, the terms they take up, and a cue of the type. pairs: query, answer."""
    q, a = F.col("query"), F.col("answer")
    x = pairs.select(*id_columns, "answer", F.lower("answer").alias("la"), answer_type(q).alias("type"), answer_domain(q).alias("domain"), key_terms(q).alias("t"))
    taken = F.size(F.filter("t", lambda t: F.contains("la", F.lower(t))))
    has = lambda *cues: F.col("answer").rlike("|".join(cues))
    cue = ((F.col("type") == "definitional") & has("is", "refers to")) | ((F.col("type") == "procedural") & has("step", "process")) | ((F.col("type") == "comparative") & has("compare", "difference"))
    n = F.octet_length(a)
    score = 0.5 + F.when(n.between(low, high), 0.1).otherwise(0.0) + F.coalesce(F.try_divide(taken.cast("double"), F.size("t")), F.lit(0.0)) * 0.3 + F.when(cue, 0.1).otherwise(0.0)
    return x.select(*id_columns, "type", "domain", F.coalesce(F.get("t", F.lit(0)), F.lit("the topic")).alias("subject"), F.size("t").cast("long").alias("n_terms"), F.round(F.least(score, F.lit(1.0)), 6).alias("confidence"))
