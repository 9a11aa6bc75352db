"""Rule-based analyses of a text as expressions: sentiment, language shares, writing metrics, entities, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, letter_words, squeeze

# The sentiment lexicon and its negations.
POSITIVE = (
    "thank", "thanks", "grateful", "appreciate", "great", "excellent", "wonderful", "perfect", "approved", "congratulations", "happy", "pleased", "welcome", "agree", "good",
    "fantastic", "amazing", "brilliant", "delighted", "love", "danke", "vielen", "positiv", "genehmigt", "erfreut", "zufrieden", "gut", "prima", "hilfreich",
)
NEGATIVE = (
    "unfortunately", "sorry", "problem", "issue", "urgent", "critical", "error", "fail", "failed", "failure", "complaint", "disappointed", "concerned", "worried", "delay",
    "rejected", "denied", "wrong", "broken", "unable", "leider", "problematisch", "kritisch", "fehler", "fehlgeschlagen", "beschwerde", "abgelehnt", "verweigert", "sorge", "verzögerung",
)
NEGATIONS = (
    "not", "no", "never", "neither", "nor", "don't", "doesn't", "didn't", "won't", "can't", "cannot", "nicht", "kein", "keine", "keinen", "keinem", "keiner", "nie",
)

# Entity patterns, and the mail providers that are no organisations.
URL = r"(?i)https?://[^\s<>\"'\]]+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+\d{1,3}[ \t.-]?)?(?:\(?\d{2,5}\)?[ \t.-]?)?\d[\d \t.\-/]{5,16}\d"
MENTION = r"@[a-zA-Z]\w{1,30}"
DATE_LIKE = r"^\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}$"
IP_LIKE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
PROVIDERS = (
    "gmail.com", "googlemail.com", "google.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "yahoo.de", "yahoo.co.uk", "gmx.de", "gmx.net", "gmx.at", "gmx.ch",
    "web.de", "t-online.de", "freenet.de", "arcor.de", "aol.com", "aol.de", "icloud.com", "me.com", "mac.com", "protonmail.com", "proton.me", "zoho.com", "yandex.com", "mail.com",
    "posteo.de", "mailbox.org",
)

# Event rules.
EVENT_RULES = (
    ("request", r"(?i)\b(request|please|bitte|beantrage|ich bitte|ich ersuche|um rueckmeldung|um rückmeldung)\b"),
    ("denial", r"(?i)\b(denied|cannot approve|not possible|abgelehnt|nicht moeglich|nicht möglich|nicht genehmigt)\b"),
    ("approval", r"(?i)\b(approved|genehmigt|zugesagt|freigegeben|bewilligt)\b"),
    ("escalation", r"(?i)\b(escalat|eskalation|compliance|rechtlich|legal team|vorstand|geschaeftsfuehrung|geschäftsführung)\b"),
    ("meeting_change", r"(?i)\b(meeting|termin|besprechung|verschoben|rescheduled|calendar|einladung|invite)\b"),
    ("deadline_pressure", r"(?i)\b(heute|bis morgen|deadline|frist|asap|sofort|umgehend|spaetestens|spätestens)\b"),
    ("exclusion_or_omission", r"(?i)\b(not included|excluded|omit|ausgeschlossen|nicht beteiligt|nicht einbezogen|ohne sbv)\b"),
    ("accommodation_or_participation", r"(?i)\b(bem|sgb\s*ix|schwerbehindertenvertretung|sbv|personalrat|betriebsrat|wiedereingliederung)\b"),
    ("comparator_treatment", r"(?i)\b(comparator|vergleichsperson|ungleichbehandlung|gleichbehandlung|agg|peer treatment)\b"),
)

# What introduces an action item, and what a decision; the clause follows.
ACTION_STARTS = (
    r"(?:please|pls|kindly)\s+", r"(?:bitte)\s+", r"(?:need to|needs to|have to|has to)\s+", r"(?:wir\s+müssen|du\s+musst|sie\s+müssen|bitte\s+um)\s+", r"(?:can you|could you|would you)\s+",
    r"(?:kannst du|könntest du|können sie)\s+", r"(?:I(?:'ll| will| am going to))\s+", r"(?:ich\s+werde|wir\s+werden)\s+", r"(?:action required|action item|todo|to do|follow up|follow-up)[:\s]+",
    r"(?:maßnahme|aufgabe|to-do|erledigen|nachfassen)[:\s]+", r"(?:by|before|deadline|due(?:\s+date)?)[:\s]+", r"(?:bis|frist|spätestens|fällig(?:keit)?)[:\s]+",
)
DECISION_STARTS = (
    r"(?:we decided|we've decided|it was decided)\s+(?:to\s+)?", r"(?:wir\s+haben\s+entschieden|es\s+wurde\s+entschieden)\s+(?:zu\s+)?", r"(?:agreed to|have agreed|agreement to)\s+",
    r"(?:wir\s+haben\s+vereinbart|vereinbart\s+wurde)\s+", r"(?:confirmed that|confirming that)\s+", r"(?:bestätigt(?:\s+wurde)?|wir\s+bestätigen)\s+", r"(?:approved|approval for)\s+",
    r"(?:genehmigt|freigegeben)\s+", r"(?:will proceed with|proceeding with|going ahead with)\s+", r"(?:wir\s+werden\s+fortfahren\s+mit|wir\s+gehen\s+weiter\s+mit)\s+",
    r"(?:go ahead with|let's go with|let us go with)\s+", r"(?:wir\s+gehen\s+mit|lasst\s+uns\s+mit)\s+", r"(?:final decision|the decision is)\s+", r"(?:die\s+entscheidung\s+ist|endgültig\s+entschieden)\s+",
)
CLAUSE = r"(.{10,80}?)(?:[.!?\n]|$)"
URGENT = ("asap", "urgent", "urgently", "immediately", "critical", "high priority", "time-sensitive", "deadline", "dringend", "sofort", "zeitkritisch", "eilig")

# The shortest list of stop words that tells the corpus's languages apart; longer lists are a parameter.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "it", "with", "as", "are", "this", "be"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "nicht", "ein", "eine", "auf", "für", "im"),
    "fr": ("le", "la", "les", "et", "des", "une", "du", "dans", "que", "qui", "pour", "sur", "pas", "avec", "est"),
    "es": ("el", "los", "las", "del", "por", "con", "para", "una", "como", "más", "pero", "su", "que", "se", "no"),
}


def sentiment(text: Column) -> Column:
    """struct(label, score, positive, negative): lexicon words, turned round by a negation one or two words before."""
    negations = F.array(*map(F.lit, NEGATIONS))

    def signs(tokens: Column) -> Column:
        def polarity(word: Column, i: Column) -> Column:
            sign = F.when(word.isin(*POSITIVE), 1).when(word.isin(*NEGATIVE), -1).otherwise(0)
            turned = F.arrays_overlap(F.slice(tokens, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), negations)
            return F.when((sign != 0) & (i > 0), F.when(turned, -sign).otherwise(sign)).otherwise(sign)

        return F.transform(tokens, polarity)

    def summed(found: Column) -> Column:
        good, bad = F.size(F.filter(found, lambda s: s > 0)), F.size(F.filter(found, lambda s: s < 0))
        score = F.when(good + bad == 0, 0.0).otherwise((good - bad) / (good + bad))
        label = F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")
        return F.struct(label.alias("label"), F.round(score, 4).alias("score"), good.alias("positive"), bad.alias("negative"))

    return bind(bind(letter_words(text), signs), summed)


def language_shares(rows: DataFrame, key: str, text: str, stop_words: dict[str, tuple[str, ...]] = STOP_WORDS) -> DataFrame:
    """(key, tokens, language, share): the language with the largest share of stop words, ties by name; unknown below 0.02."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-zàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ]+"), F.lit(0))
    share = lambda words: F.size(F.filter(F.col("tokens_"), lambda t: t.isin(*words))) / F.size("tokens_")
    scored = rows.select(F.col(key), tokens.alias("tokens_")).select(key, F.size("tokens_").alias("tokens"), *(F.when(F.size("tokens_") > 0, share(w)).otherwise(0.0).alias(f"s_{name}") for name, w in stop_words.items()))
    best = F.array_max(F.array(*(F.struct(F.round(f"s_{n}", 6).alias("share"), F.lit(-i).alias("order"), F.lit(n).alias("language")) for i, n in enumerate(sorted(stop_words)))))
    return scored.select(key, F.col("tokens").cast("long").alias("tokens"), F.when(best["share"] < 0.02, "unknown").otherwise(best["language"]).alias("language"), best["share"].alias("share"))


def writing_metrics(text: Column) -> Column:
    """struct of sentence, word and style measures; null for texts under 20 characters or 5 words."""
    body = F.coalesce(text, F.lit(""))
    ratio = lambda x, y, places: F.round(x / y, places)

    # each text is cut once, and its words and sentences are bound to what counts them
    def measured(parts: Column) -> Column:
        words, ends, n = parts["words"], parts["ends"], F.size(parts["words"])
        sums = F.aggregate(words, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("long")), lambda a, w: F.struct((a["chars"] + F.length(w)).alias("chars"), (a["long"] + (F.length(w) > 6).cast("int")).alias("long")))
        counted = lambda s: F.struct(
            n.alias("word_count"), ends.alias("sentence_count"), ratio(n, ends, 2).alias("avg_sentence_length"), ratio(s["chars"], n, 2).alias("avg_word_length"),
            ratio(F.size(F.array_distinct(words)), n, 4).alias("vocabulary_richness"), ratio(F.regexp_count(body, F.lit(r"\?")), ends, 4).alias("question_frequency"),
            ratio(F.regexp_count(body, F.lit("!")), ends, 4).alias("exclamation_frequency"), ratio(s["long"], n, 4).alias("formality_score"),
        )
        return F.when(n >= 5, bind(sums, counted))

    words = F.regexp_extract_all(F.lower(body), F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), F.lit(0))
    ends = F.greatest(F.lit(1), F.size(F.filter(F.split(F.trim(body), r"(?<!\.)\.(?!\.)\s+|[!?]+\s+|(?<!\.)\.(?!\.)$|[!?]+$"), lambda s: F.trim(s) != "")))
    return F.when(F.length(F.trim(body)) >= 20, bind(F.struct(words.alias("words"), ends.alias("ends")), measured))


def measured(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, measures...) of the texts that have them; made by an outer generator, as a filter on the measures or on its array would compute them again."""
    return rows.select(key, F.inline_outer(F.array(writing_metrics(F.col(text))))).where("word_count is not null")


def _trim_url(url: Column) -> Column:
    """Without closing marks, nor brackets that were never opened."""
    plain = F.regexp_replace(url, r"[.,;:!?]+$", "")
    surplus = F.greatest(F.lit(0), F.regexp_count(plain, F.lit(r"\)")) - F.regexp_count(plain, F.lit(r"\(")))
    closing = F.length(F.regexp_extract(plain, r"(\)*)$", 1))
    return F.substring(plain, F.lit(1), F.length(plain) - F.least(surplus, closing))


def entities(rows: DataFrame, key: str, text: str, kinds: tuple[str, ...] = ("url", "email", "phone", "mention")) -> DataFrame:
    """(key, kind, entity): distinct URLs, addresses, phone numbers (digits) and mentions of each text; only the patterns of ``kinds`` run."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = lambda pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    phones = F.filter(F.transform(every(PHONE), lambda p: F.trim(p)), lambda p: ~p.rlike(DATE_LIKE) & ~p.rlike(IP_LIKE))
    phones = F.filter(F.transform(phones, lambda p: F.regexp_replace(p, r"\D", "")), lambda p: F.length(p) >= 7)
    found = (("url", F.transform(every(URL), _trim_url)), ("email", every(EMAIL)), ("phone", phones), ("mention", every(MENTION)))
    lists = F.array(*(F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.transform(values, lambda v: F.lower(v))).alias("values")) for kind, values in found if kind in kinds))
    each = rows.select(F.col(key), F.explode(lists).alias("k"))
    return each.select(key, F.col("k.kind").alias("kind"), F.explode("k.values").alias("entity"))


def organisation(address: Column) -> Column:
    """The domain of an address unless it is a mail provider."""
    domain = F.lower(F.trim(F.element_at(F.split(address, "@"), -1)))
    return F.when(F.contains(address, F.lit("@")) & (domain != "") & ~domain.isin(*PROVIDERS), domain)


def event_hits(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, event_kind, trigger, event_key): distinct rule hits of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(0)), squeeze)).alias("hits")) for kind, p in EVENT_RULES))
    each = rows.select(F.col(key), F.explode(kinds).alias("k")).select(key, F.col("k.kind").alias("event_kind"), F.explode("k.hits").alias("trigger"))
    return each.withColumn("event_key", F.sha2(F.concat_ws("|", key, "event_kind", F.lower("trigger")), 256))


def clauses(rows: DataFrame, key: str, text: str, starts: tuple[str, ...]) -> DataFrame:
    """(key, clause): what follows the given openings, distinct by its lower-cased text, at least 5 characters."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.flatten(F.array(*(F.regexp_extract_all(body, F.lit(f"(?i){s}{CLAUSE}"), F.lit(1)) for s in starts)))
    clean = F.filter(F.transform(found, lambda c: F.trim(c)), lambda c: F.length(c) >= 5)
    return rows.select(F.col(key), F.explode(F.array_distinct(F.transform(clean, lambda c: F.lower(c)))).alias("clause"))


def urgency(clause: Column) -> Column:
    return F.exists(F.array(*map(F.lit, URGENT)), lambda w: F.contains(F.lower(clause), w))
