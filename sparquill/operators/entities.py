"""Entities that patterns find in texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Large cities that are locations without a state.
CITIES = (
    "New York|Los Angeles|Chicago|Houston|Phoenix|Philadelphia|San Antonio|San Diego|Dallas|San Jose|Austin|Jacksonville|Fort Worth|Columbus|Charlotte|San Francisco|Indianapolis|Seattle|Denver|Washington|"
    "Boston|El Paso|Detroit|Nashville|Portland|Memphis|Oklahoma City|Las Vegas|Louisville|Baltimore|Milwaukee|Albuquerque|Tucson|Fresno|Sacramento|Mesa|Kansas City|Atlanta|Long Beach|Colorado Springs|"
    "Raleigh|Miami|Virginia Beach|Omaha|Oakland|Minneapolis|Tulsa|Arlington|Tampa|New Orleans|Wichita|Cleveland|Bakersfield|Aurora|Anaheim|Honolulu|Santa Ana|Riverside|Corpus Christi|Lexington|Stockton|"
    "Henderson|Saint Paul|St. Paul|Cincinnati|St. Louis|Pittsburgh|Greensboro|Lincoln|Plano|Anchorage|Durham|Jersey City|Chula Vista|Orlando|Chandler|Henderson|Laredo|Buffalo|North Las Vegas|Madison|"
    "Lubbock|Reno|Akron|Hialeah|Garland|Rochester|Modesto|Montgomery|Yonkers|Spokane|Tacoma|Shreveport|Des Moines|Fremont|Baton Rouge|Richmond|Birmingham|Chesapeake|Glendale|Irving|Scottsdale|"
    "North Hempstead|Fayetteville|Grand Rapids|Santa Clarita|Salt Lake City|Huntsville"
)
# Technical terms.
TERMS = (
    r"API|SDK|HTTP|HTTPS|JSON|XML|SQL|NoSQL|REST|GraphQL|OAuth|JWT|SSL|TLS|CSS|HTML|JavaScript|TypeScript|Python|Java|Rust|Go|C\+\+|PHP|Ruby|Swift|Kotlin|React|Vue|Angular|Docker|Kubernetes|AWS|GCP|Azure|"
    r"MongoDB|PostgreSQL|MySQL|Redis|Elasticsearch|TensorFlow|PyTorch|OpenAI|GPT|BERT|Transformer|Neural Network|Machine Learning|Deep Learning|AI|ML|DL|NLP|Computer Vision|Data Science|Big Data|"
    r"Cloud Computing|DevOps|CI/CD|Git|GitHub|GitLab|Bitbucket|Jenkins|Travis CI|CircleCI|Terraform|Ansible|Chef|Puppet"
)
# Patterns of each kind, in order.
PATTERNS = (
    ("person", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
    ("person", r"\b(?:Mr|Mrs|Dr|Prof|Ms)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"),
    ("organization", r"\b[A-Z][a-zA-Z]*\s+(?:Inc|Corp|Company|Ltd|LLC|Organization|Institute|University|College|School)\b"),
    ("organization", r"\b(?:the\s+)?[A-Z][a-zA-Z\s]+(?:Corporation|Foundation|Association|Agency|Department)\b"),
    ("location", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2}\b"),
    ("location", rf"\b(?:{CITIES})\b"),
    ("datetime", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"),
    ("datetime", r"\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("datetime", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("money", r"\$\d+(?:,\d{3})*(?:\.\d{2})?\b"),
    ("money", r"\b\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:dollars?|USD|cents?)\b"),
    ("percentage", r"\b\d+(?:\.\d+)?%\b"),
    ("percentage", r"\b\d+(?:\.\d+)?\s*percent\b"),
    ("technical", r"\b[A-Z]{2,}(?:\s+[A-Z]{2,})*\b"),
    ("technical", rf"\b(?:{TERMS})\b"),
)


# What a start that fails passes over, since no start within it can do better: else long runs would be read anew from each of their words.
PASSED = {
    PATTERNS[3][1]: r"\b(?:the\s+)?[A-Z][a-zA-Z\s]*+[^a-zA-Z\s]?",
    PATTERNS[4][1]: r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+",
    PATTERNS[10][1]: r"\b\d+(?:,\d{3}\b)*+",
}


# Patterns of words from a list: what the list's words begin with, so that no other word is held against all of them.
BEGINS = {PATTERNS[5][1]: "[A-Z]", PATTERNS[6][1]: "[A-Z]", PATTERNS[14][1]: "[A-Z]"}
# Patterns that need one of a few words: texts without any are passed over.
NEEDS = {PATTERNS[3][1]: ("Corporation", "Foundation", "Association", "Agency", "Department"), PATTERNS[9][1]: ("$",), PATTERNS[10][1]: ("dollar", "USD", "cent"), PATTERNS[11][1]: ("%",), PATTERNS[12][1]: ("percent",)}


def without_recursion(pattern: str) -> str:
    """The same matches from repeats that never step back: each ends where a word does, so long runs of names can't exhaust the stack."""
    return pattern.replace(r")*\b", r"\b)*+\b").replace(")*,", ")*+,")


def _found(pattern: str) -> Column:
    """All matches in the text, in time that grows with its length."""
    own, passed = without_recursion(pattern), PASSED.get(pattern)
    if pattern in BEGINS:
        own = rf"\b(?={BEGINS[pattern]})" + own.removeprefix(r"\b")
    found = F.regexp_extract_all("text", F.lit(f"{own}|{passed}" if passed else own), F.lit(0))
    if passed:
        found = F.filter(found, lambda x: x.rlike(f"^(?:{own})\\z"))
    needs = [F.contains("text", F.lit(word)) for word in NEEDS.get(pattern, ())]
    return F.when(reduce(Column.__or__, needs), found).otherwise(F.array().cast("array<string>")) if needs else found


def mentions(docs: DataFrame, patterns: tuple[tuple[str, str], ...] = PATTERNS) -> DataFrame:
    """(kind, rule, entity, mentions, documents) over whole texts, white space in entities as one space; patterns may be one's own."""

    def of(rule: int, kind: str, pattern: str) -> Column:
        return F.transform(_found(pattern), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.regexp_replace(x, r"\s+", " ").alias("entity")))

    found = F.concat(*(of(i, kind, pattern) for i, (kind, pattern) in enumerate(patterns)))
    return docs.select("doc_id", F.inline(found)).groupBy("kind", "rule", "entity").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"))
