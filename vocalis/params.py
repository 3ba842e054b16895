"""Analysis parameters: word lists, windows, thresholds.

Nothing in the operators is hard-coded: every list is an argument, carried as
an array literal (small, bounded by the user) so that keyword tests compile to
JVM-side higher-order functions instead of joins.

Two bindings are provided:

* ``election_params()`` -- the original use case (state governorship races).
* ``driver_params()``   -- the binding used on the synthetic driver tables,
  chosen so that every gate of the discovery does something on that prose.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    # --- scopes -----------------------------------------------------------
    scopes: tuple[str, ...] = ()
    # extra spellings of a scope found in text (the scope itself always counts)
    scope_variants: dict[str, tuple[str, ...]] = field(default_factory=dict)
    # --- name filtering ---------------------------------------------------
    stop_words: tuple[str, ...] = ()
    stop_phrases: tuple[str, ...] = ()
    scope_names: tuple[str, ...] = ()
    title_prefixes: tuple[str, ...] = ()
    # --- proximity gates --------------------------------------------------
    role_keywords: tuple[str, ...] = ()
    rival_keywords: tuple[str, ...] = ()
    context_words: tuple[str, ...] = ()
    role_window: int = 80
    scope_window: int = 100
    min_mentions: int = 2
    top_k: int = 20
    # --- sentiment --------------------------------------------------------
    lexicon: dict[str, float] = field(default_factory=dict)
    max_score_chars: int = 1000
    confidence_threshold: float | None = None
    # --- profile ----------------------------------------------------------
    theme_stop_words: tuple[str, ...] = ()
    theme_min_len: int = 3
    themes_top: int = 15
    excerpts_top: int = 5
    excerpt_chars: int = 200
    support_categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    region_keywords: tuple[str, ...] = ()
    regions_top: int = 5
    # --- ingestion --------------------------------------------------------
    keyword_templates: tuple[str, ...] = ()
    relevance_words: tuple[str, ...] = ()
    as_of: str = "2024-02-12"
    months: int = 12
    min_post_chars: int = 20
    min_comment_chars: int = 10

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    def variants_for(self, scope: str) -> tuple[str, ...]:
        s = scope.lower()
        extra = self.scope_variants.get(s, self.scope_variants.get(scope, ()))
        return tuple(dict.fromkeys((s,) + tuple(v.lower() for v in extra)))


# ---------------------------------------------------------------------------
# Fixed values of the original election use case.  These must stay equal to
# the original lists for equal results; they are stated as plain text, in
# their natural order.  The general stop-word list of the original use case
# (several hundred words) is not reproduced here: pass it as ``stop_words``
# (for instance read from a text file with ``load_word_list``).
# ---------------------------------------------------------------------------
ELECTION_CONTEXT_WORDS = (
    "governor", "governorship", "gubernatorial", "guber",
    "candidate", "aspirant", "running", "contest", "campaign",
    "elect", "election", "ticket", "primary", "nominated",
    "apc", "pdp", "lp", "nnpp", "apga",
)
ELECTION_SCOPES = (
    "Abia", "Adamawa", "Akwa Ibom", "Anambra", "Bauchi", "Bayelsa",
    "Benue", "Borno", "Cross River", "Delta", "Ebonyi", "Edo",
    "Ekiti", "Enugu", "Gombe", "Imo", "Jigawa", "Kaduna", "Kano",
    "Katsina", "Kebbi", "Kogi", "Kwara", "Lagos", "Nasarawa",
    "Niger", "Ogun", "Ondo", "Osun", "Oyo", "Plateau", "Rivers",
    "Sokoto", "Taraba", "Yobe", "Zamfara", "FCT",
)
ELECTION_STOP_PHRASES = (
    "all progressives congress", "peoples democratic party",
    "labour party", "new nigeria peoples party",
    "all progressives grand alliance",
    "aso rock", "aso villa",
    "obidient movement", "sunrise daily",
    "electronic transmission", "getting polling unit",
    "polling officer", "polling unit",
    "supreme court", "appeal court",
    "local government", "civil service",
    "central bank", "world bank",
    "cross rivers", "cross river", "port harcourt",
    "fraud alert", "full scale",
    "best governor", "dey play",
    "traditional rulers", "remaining governors",
    "automatic ticket", "kano governor", "lagos governor",
    "rivers governor", "delta governor", "edo governor",
)
ELECTION_TITLE_PREFIXES = (
    "mr", "mrs", "ms", "dr", "prof", "engr", "chief", "alhaji",
    "hajia", "hon", "honourable", "sen", "senator", "gov", "governor",
    "former", "late", "pastor", "reverend", "rev", "barrister",
    "justice", "sir", "dame", "prince", "princess", "father",
    "mallam", "malam", "oba", "emir", "architect", "arc",
    "high", "grand",
)
ELECTION_ROLE_KEYWORDS = ("governor", "governorship", "gubernatorial", "guber")
ELECTION_RIVAL_KEYWORDS = ("president", "presidential", "presidency")
ELECTION_SCOPE_VARIANTS = {
    "fct": ("fct", "abuja", "federal capital"),
    "akwa ibom": ("akwa ibom", "akwa"),
    "cross river": ("cross river", "calabar"),
}
ELECTION_THEME_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "must",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her",
    "us", "them", "my", "your", "his", "its", "our", "their",
    "this", "that", "these", "those", "what", "which", "who", "whom",
    "and", "but", "or", "nor", "not", "no", "so", "if", "then",
    "than", "too", "very", "just", "don", "now", "here", "there",
    "when", "where", "why", "how", "all", "each", "every", "both",
    "few", "more", "most", "other", "some", "such", "only", "own",
    "same", "also", "for", "from", "to", "of", "in", "on", "at",
    "by", "with", "about", "against", "between", "through", "during",
    "before", "after", "above", "below", "up", "down", "out", "off",
    "over", "under", "again", "further",
    "na", "dey", "dis", "dat", "sef", "sha", "abi", "wey", "dem",
    "una", "oga", "abeg", "jare", "like", "one", "people", "even",
    "still", "already", "much", "many", "well", "say", "said",
    "going", "come", "get", "got", "make", "want", "know", "think",
    "good", "bad", "new", "old", "first", "last", "long", "great",
)
ELECTION_SUPPORT_CATEGORIES = {
    "youth": ("youth", "young", "student", "gen-z", "millennial", "next generation"),
    "urban": ("city", "urban", "metropolitan", "lagos island", "ikeja", "lekki", "victoria island"),
    "rural": ("rural", "village", "farm", "local government", "grassroots"),
    "women": ("women", "maternal", "gender", "female empowerment"),
    "diaspora": ("diaspora", "abroad", "overseas", "foreign"),
    "business": ("business", "entrepreneur", "trader", "market", "commerce", "economy"),
    "religious": ("church", "mosque", "imam", "pastor", "christian", "muslim"),
}
ELECTION_REGION_KEYWORDS = (
    "north", "south", "east", "west", "central",
    "senatorial", "local government", "lga",
)
ELECTION_RELEVANCE_WORDS = (
    "governor", "governorship", "election", "candidate", "aspirant",
    "campaign", "vote", "ballot", "primary", "contest", "gubernatorial",
    "apc", "pdp", "lp", "nnpp", "apga", "political",
    "senator", "minister", "incumbent", "2027",
)
ELECTION_KEYWORD_TEMPLATES = (
    "{state} governorship election",
    "{state} governor 2027",
    "{state} governor candidate",
    "election 2027 Nigeria {state}",
    "{state} gubernatorial",
    "who will be governor of {state}",
    "{state} election candidate",
)
# --- end of fixed values ----------------------------------------------------


def load_word_list(path: str) -> tuple[str, ...]:
    """Read a word list (one entry per line, '#' comments) -- e.g. stop words."""
    out = []
    with open(path, encoding="utf-8") as fh:
        for line in fh:
            line = line.split("#", 1)[0].strip().lower()
            if line:
                out.append(line)
    return tuple(dict.fromkeys(out))


def election_params(scopes=("Lagos", "Kano"), stop_words=None, **kw) -> Params:
    """The original use case; ``stop_words`` is the caller's general stop list.

    Without it ordinary capitalised phrases pass as people, so leaving it out
    is an error; an empty list says that none is wanted."""
    if stop_words is None:
        raise ValueError("the election binding needs a general stop-word list: pass stop_words "
                         "(see load_word_list), or () to run without one")
    p = Params(
        scopes=tuple(scopes),
        scope_variants=dict(ELECTION_SCOPE_VARIANTS),
        stop_words=tuple(w.lower() for w in stop_words),
        stop_phrases=ELECTION_STOP_PHRASES,
        scope_names=tuple(s.lower() for s in ELECTION_SCOPES),
        title_prefixes=ELECTION_TITLE_PREFIXES,
        role_keywords=ELECTION_ROLE_KEYWORDS,
        rival_keywords=ELECTION_RIVAL_KEYWORDS,
        context_words=ELECTION_CONTEXT_WORDS,
        theme_stop_words=ELECTION_THEME_STOP_WORDS,
        support_categories=dict(ELECTION_SUPPORT_CATEGORIES),
        region_keywords=ELECTION_REGION_KEYWORDS,
        keyword_templates=ELECTION_KEYWORD_TEMPLATES,
        relevance_words=ELECTION_RELEVANCE_WORDS,
        months=12,
    )
    return p.with_(**kw) if kw else p


def driver_params(**kw) -> Params:
    """Binding for the synthetic driver tables (scope = document language)."""
    p = Params(
        scopes=("en", "de", "es", "fr"),
        scope_variants={s: ("version",) for s in ("en", "de", "es", "fr")},
        stop_words=("und", "and", "of", "to", "die"),
        stop_phrases=(),
        scope_names=("en", "de", "es", "fr"),
        title_prefixes=(),
        role_keywords=("licensed",),
        rival_keywords=("gnu",),
        context_words=("licensed", "version", "under", "work", "the"),
        lexicon={"the": 1.0, "that": 0.5, "and": 0.3, "of": -1.0,
                 "is": -0.5, "not": -0.8},
        theme_stop_words=ELECTION_THEME_STOP_WORDS,
        support_categories={"a": ("license", "version"), "b": ("work",)},
        region_keywords=("under", "version", "work"),
        keyword_templates=("{state} release", "{state} license", "release notes {state}"),
        relevance_words=("release", "license", "version"),
        as_of="2024-02-12",
        months=1,
    )
    return p.with_(**kw) if kw else p
