"""Ordered rules that turn counts and labels into a verdict, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task states that end a task, and those known to be live; others count as live.
CLOSED = """complete completed closed done resolved fixed cancelled canceled wontfix wontdo duplicate archived
closedworkflowneutral shipped released merged abandoned rejected invalid obsolete""".split()
OPEN = """open todo backlog new ready triage planned inprogress progress active doing started inreview review blocked
onhold paused reopened""".split()

# Names that are everywhere, and those that only rankings leave out.
COMMON_NAMES = """close open read write get set put delete update create init start stop run main test log print send
receive connect disconnect load save parse format json str int len map filter sort find index push pop append remove
clear reset error warn info debug toString valueOf hasOwnProperty constructor raise_for_status status_code text content
data result request response handler callback resolve reject __init__ __str__ __repr__ self this cls super""".split()
NOISE = """build process execute handle apply validate render toString equals hash size empty begin end next""".split()
REPORT_NOISE = """close open read write get set json log print send parse init run test str int len __init__ __str__ __repr__
raise_for_status toString""".split()
BRIEF_NOISE = """close open read write get set json log print send parse init run test str int len __init__ __str__ __repr__
raise_for_status toString handle make build map filter reduce push pop pipe next prev""".split()

# Node counts up to which a tier holds, its name and its budget of tokens.
BUDGETS = [(800, "tiny", 1500), (4000, "small", 2800), (15000, "medium", 4500), (40000, "large", 7000), (None, "huge", 10000)]


def task_status(status: Column) -> Column:
    """closed, open or unknown, however the state is spelt."""
    own = F.regexp_replace(F.lower(F.coalesce(status, F.lit(""))), "[^a-z]", "")
    return F.when(own.isin(CLOSED), "closed").when(own.isin(OPEN), "open").otherwise("unknown")


def is_noise(label: Column, where: str = "ranking") -> Column:
    """Names that a ranking, a report or a brief leaves out."""
    left_out = {"resolver": COMMON_NAMES, "ranking": [*COMMON_NAMES, *NOISE], "report": REPORT_NOISE, "brief": BRIEF_NOISE}[where]
    return F.coalesce(label.isin(left_out), F.lit(False))


def trust_level(unresolved: Column, weak: int = 2000, ok: int = 500) -> Column:
    return F.when(unresolved > weak, "weak").when(unresolved > ok, "ok").otherwise("strong")


def token_budget(nodes: Column) -> Column:
    """struct<tier, tokens> for a graph of so many nodes."""
    n = F.greatest(F.coalesce(nodes, F.lit(0)), F.lit(0))
    tiers = [F.when(n <= most if most is not None else F.lit(True), F.struct(F.lit(name).alias("tier"), F.lit(tokens).alias("tokens"))) for most, name, tokens in BUDGETS]
    return F.coalesce(*tiers)


def feature_health(resolved: Column, declared: Column, tasks: Column, contracts: Column) -> Column:
    broken = F.coalesce(resolved / F.nullif(declared, F.lit(0)), F.lit(1.0)) < 1
    return F.when(broken | (tasks > 20), "risk").when((tasks > 10) | (contracts == 0), "watch").otherwise("healthy")


def change_decision(callers: Column, tests: Column, unresolved: Column, crosses: Column, verified: Column, complete: Column) -> Column:
    """CONFIRM, REVIEW or SAFE: the first rule that holds."""
    confirm = ((callers > 5) & crosses) | (callers > 10) | ((unresolved > 100) & (callers > 3))
    return F.when(confirm, "CONFIRM").when((callers > 1) | ~verified | ~complete, "REVIEW").otherwise("SAFE")


def with_occurrences(decision: Column, callers: Column, unresolved: Column, files: Column) -> Column:
    """A decision made stricter where the name stands in more files than the graph has callers, under weak trust."""
    gap = (unresolved > 100) & (callers <= 1) & (files > 1)
    return F.when(gap & (files >= 10), "CONFIRM").when(gap & (decision == "SAFE"), "REVIEW").otherwise(decision)


def risk_band(score: Column) -> Column:
    return F.when(score >= 6, "high").when(score >= 3, "medium").otherwise("low")


# What evidence for a task's link says if it is strong, and if it is broad.
_STRONG = r"(?i)\b(tag|custom[_ -]?field|component|commit|branch|path|file|files?_hint|symbol|anchor|code|diff):|\b(explicit task tags?|custom fields?|commit[- ]message|branch[- ]name|file paths? mentioned|files?_hint|code[- ]anchored)\b"
_BROAD = r"(?i)\b(title|description|fuzzy|spec|future|roadmap|manual|broad):|\b(fuzzy title|fuzzy description|future work|broad mapping|manual mapping|spec work|roadmap)\b"


def link_strength(features: Column, declared: Column, evidence: Column, files: Column) -> Column:
    """How surely a task belongs to its features: unlinked, what it declares, else what its evidence tells."""
    said = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    text = F.concat_ws(" ", F.trim(F.coalesce(evidence, F.lit(""))), F.array_join(F.coalesce(files, F.array().cast("array<string>")), " "))
    strong = (F.coalesce(F.size(files), F.lit(0)) > 0) | text.rlike(_STRONG)
    broad = text.rlike(_BROAD)
    return (
        F.when(F.coalesce(F.size(features), F.lit(0)) == 0, "unlinked").when(said.isin("strong", "mixed", "broad"), said)
        .when(strong & ~broad, "strong").when(broad & ~strong, "broad").otherwise("mixed")
    )


# Roles in their order; what path or label holds, what the label alone holds, the type that they need.
ROLES = [
    ("middleware", "middleware|kernel", "", ""),
    ("handler", "controller", "", ""),
    ("routing", "/route|router", "", ""),
    ("entity", r"/entity/|/entities/|/models/|entity\.|model\.|record\.", "(entity|model|record)$", ""),
    ("factory", "factory|builder|provider", "", ""),
    ("repository", r"repository|repo\.|dao", "", ""),
    ("request/validation", "/request|formrequest", "", "Class"),
    ("service", "/service|/processor|/command|/job|/task", "", ""),
    ("renderer", "", "render|format|serializ", ""),
    ("storage", r"/storage/|/database/|/db\.|storage\.|/store/", "", ""),
    ("pipeline", "resolve|orchestr|freshness|pipeline|ingest", "", ""),
]
PLAIN_ROLES = {"Class": "class", "Method": "method", "Function": "fn"}


def role_of(label: Column, path: Column, kind: Column) -> Column:
    """What part a symbol plays: the first role whose words are there, else what its type says."""
    where, name = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))

    def plays(words: str, own: str, needs: str) -> Column:
        hit = F.lit(False)
        for text, pattern in ((where, words), (name, words), (name, own)):
            hit = hit | text.rlike(pattern) if pattern else hit
        return hit & (kind == needs) if needs else hit

    plain = [F.when(kind == k, F.lit(r)) for k, r in PLAIN_ROLES.items()]
    return F.coalesce(*[F.when(plays(*conditions), F.lit(role)) for role, *conditions in ROLES], *plain, F.nullif(F.lower(kind), F.lit("")), F.lit("symbol"))


# Modules that come with a language, and buckets of unresolved references in their order with their
# relations, extractors (empty: any) and pattern of the target.
_NODE = "assert|buffer|child_process|crypto|events|fs|http|https|net|os|path|process|stream|url|util|zlib"
_PYTHON = """os|sys|re|json|math|time|datetime|typing|collections|functools|itertools|logging|pathlib|unittest|pytest|asyncio|subprocess|threading|socket|abc|dataclasses|enum|warnings|contextlib|io"""
_WORD = "^[A-Za-z_][A-Za-z0-9_]*$"
# Names that a script's runtime gives, and headers of the C++ standard library.
SCRIPT_GLOBALS = """__dirname __filename require module exports process console globalThis global Buffer setTimeout setInterval
clearTimeout clearInterval setImmediate clearImmediate queueMicrotask URL URLSearchParams TextEncoder TextDecoder""".split()
STANDARD_HEADERS = """algorithm any array atomic barrier bit bitset cassert cctype cerrno cfenv cfloat charconv chrono cinttypes climits
clocale cmath codecvt compare complex concepts condition_variable coroutine csetjmp csignal cstdarg cstaddef cstddef cstdint cstdio
cstdlib cstring ctime cuchar cwchar cwctype deque exception execution expected filesystem format forward_list fstream functional
future initializer_list iomanip ios iosfwd iostream istream iterator latch limits list locale map memory memory_resource mutex new
numbers numeric optional ostream queue random ranges ratio regex scoped_allocator semaphore set shared_mutex source_location span
sstream stack stdexcept stop_token streambuf string string_view strstream syncstream system_error thread tuple type_traits
typeindex typeinfo unordered_map unordered_set utility valarray variant vector version""".split()
BUCKETS = [
    ("external-by-design:node-builtin", ["IMPORTS"], [], rf"^(node:[A-Za-z0-9_./-]+|{_NODE})(\.|$)"),
    ("external-by-design:npm", ["IMPORTS"], ["javascript", "typescript"], r"^(@[a-z0-9_~-]+/[a-z0-9_~-]+|[a-z@][a-z0-9@_-]*)(\.|$)"),
    ("external-by-design:python-stdlib", ["IMPORTS"], ["python"], rf"^({_PYTHON})(\.|$)"),
    ("external-by-design:pip", ["IMPORTS"], ["python"], r"^[a-z][a-z0-9_]*(\.[a-z0-9_]+)*$"),
    ("external-by-design:cpp-system", ["IMPORTS"], ["cpp", "c"], rf"^\s*({'|'.join(STANDARD_HEADERS)})\s*$|^\s*<|(?i:\.(h|hpp|hh|hxx|inl|ipp))\s*$|^\s*(std|boost|glm|vma|vulkan|imgui|entt|flecs)\b"),
    ("external-by-design:php-framework", [], ["php", "laravel"], r"^(Illuminate|Symfony|Laravel|Eloquent|DB|Cache|Log|Auth|Queue|Event)(\.|$|\\)"),
    ("shape-issue:contains-missing-target", ["CONTAINS"], [], r"^\s*$"),
    ("shape-issue:empty-target", [], [], r"^\s*$"),
    ("shape-issue:operator-only", [], [], r"^[()\[\]{}<>+\-*/=!?:;,.$#@&|^~%\s`'\"]+$"),
    ("denylisted-by-design:common-name", ["CALLS", "REFERENCES"], [], f"^({'|'.join(COMMON_NAMES)})$"),
    ("denylisted-by-design:js-global", ["CALLS", "REFERENCES"], [], f"^({'|'.join(SCRIPT_GLOBALS)})$"),
    ("fixable:call-short-name", ["CALLS"], [], _WORD),
    ("fixable:reference-short-name", ["REFERENCES"], [], _WORD),
    ("fixable:qualified-path", [], [], r"[./]"),
]


def unresolved_bucket(relation: Column, target: Column, extractor: Column) -> Column:
    """Why a reference stays unresolved: the first bucket whose conditions all hold, else unclassified."""

    def holds(relations: list[str], extractors: list[str], pattern: str) -> Column:
        own = F.coalesce(target, F.lit("")).rlike(pattern)
        own = own & relation.isin(relations) if relations else own
        return own & extractor.isin(extractors) if extractors else own

    return F.coalesce(*[F.when(holds(*conditions), F.lit(name)) for name, *conditions in BUCKETS], F.lit("unclassified"))


def counts_for_trust(relation: Column, bucket: Column) -> Column:
    """Whether an unresolved reference is a gap that could be mended."""
    return (relation != "CONTAINS") & ~bucket.rlike("^(external-by-design|shape-issue|denylisted-by-design):")


def text_match(text: Column, query: str) -> Column:
    """How well a text matches: equal, begins, holds, holds as a token."""
    own, q = F.lower(F.coalesce(text, F.lit(""))), query.lower()
    return F.when(own == q, 500).when(own.startswith(q), 300).when(own.contains(q), 100).otherwise(0)
