"""Categories, intents, business facts and page types, by patterns and word lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, hits, matches, word_count

# Patterns and word lists.
BUSINESS_SECTIONS = (
    "(Executive Summary|Financial Performance|Business Overview|Risk Factors|Management Discussion|Market Analysis|Annual Report|Quarterly Report"
    "|Financial Highlights|Shareholder|Revenue|EBITDA|Balance Sheet|Income Statement|Cash Flow|Résumé Exécutif|Performance Financière"
    "|Aperçu des Activités|Facteurs de Risque|Discussion de la Direction|Analyse du Marché|Rapport Annuel|Rapport Trimestriel"
    "|Faits Saillants Financiers|Actionnaire|Chiffre d'Affaires|Bilan|Compte de Résultat|Flux de Trésorerie)"
)
BUSINESS_METRICS = (
    "(Revenue|EBITDA|Net Income|Gross Profit|Operating Income|Total Assets|Shareholders.{0,10}Equity|Return on|ROI|ROE|Dividend"
    "|Earnings per Share|EPS|Market Cap|P/E Ratio|Debt to Equity|Chiffre d'Affaires|Résultat Net|Bénéfice Net|Résultat Opérationnel"
    "|Actif Total|Capitaux Propres|Rendement|Dividende|Capitalisation Boursière)"
)
COMPANIES = (
    r"(Inc\.|Ltd\.|Corp\.|Corporation|Company|SA|SAS|SARL|Group|Holdings|Enterprises|Solutions|Technologies|CEO|CFO|Board of Directors"
    r"|Fiscal Year|FY\s*\d{4})"
)
FISCAL = r"(FY\s*(\d{4})|Fiscal Year\s*(\d{4})|Year Ended\s*\w+\s*\d{1,2},?\s*(\d{4})|For the year ended|Annual Report\s*(\d{4}))"
CITATIONS = r"(\[(\d+|\w+)\]|\(\w+\s+et\s+al\.?,?\s+\d{4}\)|doi:|arXiv:|References|Bibliography)"
ACADEMIC_SECTIONS = "(Abstract|Introduction|Methodology|Results|Discussion|Conclusion|References)"
LEGAL_CLAUSES = "(Article|Clause|Section|Whereas|Therefore)"
LEGAL_TERMS = "(Party|Obligation|Liability|Termination|Contract)"
CODE = r"(```|`\w+`|def\s+\w+|class\s+\w+|function\s+\w+)"
SPECIFICATIONS = "(Specification|Implementation|Algorithm|API|Interface)"
NUMBER = r"([0-9]+(?:[,.]\s*[0-9]{3})*(?:[,.]?[0-9]+)?)"
SCALE = "(million[s]?|billion[s]?|milliard[s]?|M|B|Md)?"
MONEY = r"(?:\$|€|USD|EUR)?"
KPIS = {
    "Revenue": r"(revenue[s]?|chiffre\s+d'affaires|ca)\s*(?:of|was|reached|increased|to|de|:|at|a\s+atteint)?\s*(?:to|à)?",
    "EBITDA": r"(EBITDA[s]?|résultat\s+opérationnel)\s*(?:of|was|reached|de|:|at|était\s+de)?",
    "Net Income": r"(net\s+income[s]?|résultat\s+net|bénéfice\s+net)\s*(?:of|was|reached|de|:|at|s'élève\s+à)?",
    "Total Assets": r"(total\s+assets?|actif\s+total|total\s+du\s+bilan)\s*(?:of|was|reached|de|:|at|a\s+augmenté\s+à)?",
    "Market Capitalization": r"(market\s+cap(?:italization)?|capitalisation\s+boursière|valeur\s+de\s+marché)\s*(?:of|was|reached|de|:|at|atteint)?",
}
CURRENCY = r"(\$|USD|EUR|€|GBP|£|JPY|¥)"
COMPANY_NAME = r"\b([A-Z][a-zA-Z\s&]{1,30}(?:Inc\.|Corp\.|Corporation|Company|Ltd\.|Limited|SA|SAS|Group|Holdings))\b"
SECTIONS = {
    "ExecutiveSummary": r"(executive\s+summary|management\s+summary|résumé\s+exécutif|synthèse\s+direction|summary\s+of\s+operations|aperçu\s+général)",
    "FinancialHighlights": r"(financial\s+highlights|financial\s+performance|key\s+financial|faits\s+saillants\s+financiers|performance\s+financière|résultats\s+financiers|principales\s+données\s+financières|chiffres\s+clés)",
    "BusinessOverview": r"(business\s+overview|company\s+overview|business\s+description|aperçu\s+des\s+activités|présentation\s+du\s+groupe|description\s+de\s+l'entreprise|activités\s+du\s+groupe|notre\s+entreprise)",
    "RiskFactors": r"(risk\s+factors|risks\s+and|business\s+risks|facteurs\s+de\s+risque|risques\s+et\s+incertitudes|principaux\s+risques|gestion\s+des\s+risques)",
    "MarketAnalysis": r"(market\s+analysis|industry\s+analysis|competitive\s+landscape|analyse\s+du\s+marché|étude\s+de\s+marché|environnement\s+concurrentiel|secteur\s+d'activité|positionnement\s+concurrentiel)",
}
SECTORS = {
    "Technology": "(technology|software|digital|tech|IT|cloud|AI)",
    "Financial": "(financial|banking|insurance|investment|finance)",
    "Healthcare": "(healthcare|pharmaceutical|medical|biotech|health)",
}
DOMAIN_TERMS = {
    "Business": ("revenue", "profit", "ebitda", "financial", "performance", "earnings", "sales", "market", "strategy", "growth", "chiffre d'affaires", "bénéfice", "résultat", "croissance"),
    "Academic": ("research", "study", "analysis", "methodology", "experiment", "dataset", "algorithm", "model", "theory", "hypothesis", "recherche", "étude", "analyse", "expérience", "théorie"),
    "Legal": ("legal", "law", "regulation", "compliance", "procedure", "contract", "agreement", "policy", "governance", "légal", "loi", "règlement", "procédure", "contrat"),
    "Technical": ("technical", "engineering", "implementation", "system", "architecture", "design", "specification", "protocol", "technique", "ingénierie", "implémentation", "système"),
}
STRONG_LEGAL = (
    r"\barrêtés?\b", r"\bdécrets?\b", r"\bprocédures?\b", r"\bjuridictions?\b", r"\bassignations?\b", r"\barticles?\s+L\.?\s*\d+",
    r"\bcode\s+de\s+procédure\b", r"\bstatutory\b", r"\bsubpoenas?\b", r"\blitigations?\b", r"\bcompliance\s+policy\b",
    r"\blegal\s+proceedings?\b", r"\brecours\b", r"\btribunaux?\b",
)
USER_INTENTIONS = {
    "Summary": (r"(résume|résumé|summary|synthèse|points? clés?)", r"(principales? idées?|essentiel|en bref)"),
    "Search": (r"(recherche|vérifie|fact.?check|trouve|cherche)", r"(informations?|données?|sources?)"),
    "Recommendation": (r"(recommande|propose|suggère|conseille)", r"(actions?|étapes?|que faire)"),
    "Translation": (r"(traduis|translate|en (anglais|français|espagnol))", r"(translation|traduction)"),
    "Explanation": (r"(explique|qu.est.?ce|comment|pourquoi)", r"(définition|signification|sens)"),
}
CONCEPTUAL = ("comment", "pourquoi", "qu'est-ce", "quelle est", "quel est", "how", "why", "what is", "which", "expliquer", "décrire", "explain", "describe")
FIGURE_WORDS = ("figure", "fig.", "fig ", "table", "tableau", "graph", "graphique", "chart", "courbe", "shows", "montre", "illustre", "illustrates", "depicts", "représente")
DATA_WORDS = ("compression ratio", "taux de compression", "accuracy", "précision", "performance", "%", "percent", "pourcent")
COMMERCE_WORDS = ("€", "$", "prix", "price", "tarif", "cost")
ARTICLE_WORDS = ("article", "author", "published", "news")
PRICES = (
    r"(\d+[,.]?\d*)\s*€", r"(\d+[,.]?\d*)\s*\$", r"(\d+[,.]?\d*)\s*£", r"(\d+[,.]?\d*)\s*(EUR|USD|GBP)",
    r"(?iu)(à partir de|from|starting at)\s+(\d+[,.]?\d*)\s*[€$£]", r"(?i)(prix|price|tarif|cost)[\s:]+(\d+[,.]?\d*)\s*[€$£]",
)
BLOCKED_DOMAINS = ("banking", "paypal", "stripe", "chrome://", "file://", "localhost:3000", "127.0.0.1", "intranet", "internal")
ANY_CASE = "(?iu)"


def gated(flags: str, pattern: str) -> str:
    """A pattern with the same matches and groups that first looks at two characters.

    ``pattern`` is a group of alternatives that begin with two letters (or a letter and a stroke), or one that does, maybe after a word boundary. At most places of
    a text the look ahead fails, and the alternatives are not tried one by one.
    """
    one = pattern.removeprefix(r"\b")
    heads = [h[:2] for h in (one[1:-1].split("|") if one.startswith("(") else [one])]
    if not all(re.fullmatch(r"\w[\w/]", h) for h in heads):
        raise ValueError(f"alternatives must begin with two letters: {pattern}")
    first, second = ("".join(sorted({h[n] for h in heads})) for n in (0, 1))
    return f"{flags}(?=[{first}][{second}]){pattern}"


def fiscal_year(text: Column) -> Column:
    """The year of the first fiscal phrase, if it lies in 2000 to 2030."""
    years = [F.expr("try_cast(NULL as int)")]
    for n in range(2, 6):
        years.append(F.nullif(F.regexp_extract(text, gated(ANY_CASE, FISCAL), n), F.lit("")).cast("int"))
    year = F.coalesce(*years)
    return F.when(year.between(2000, 2030), year)


def business_confidence(sections: Column, metrics: Column, companies: Column, summary: Column, fiscal: Column) -> Column:
    total = F.when(summary, 0.3).otherwise(0.0) + F.least(sections * 0.1, F.lit(0.4)) + F.least(metrics * 0.05, F.lit(0.4))
    return F.least(F.round(total + F.least(companies * 0.03, F.lit(0.2)) + F.when(fiscal, 0.2).otherwise(0.0), 6), F.lit(1.0))


def signals(text: Column) -> Column:
    """All counts that the categories need, each pattern counted once: a struct to be bound once for a row."""
    counts = {
        "sections": gated(ANY_CASE, BUSINESS_SECTIONS), "metrics": gated(ANY_CASE, BUSINESS_METRICS), "companies": gated(ANY_CASE, COMPANIES),
        "citations": "(?U)" + CITATIONS, "headings": gated(ANY_CASE, ACADEMIC_SECTIONS), "clauses": gated(ANY_CASE, LEGAL_CLAUSES), "terms": gated(ANY_CASE, LEGAL_TERMS),
        "code": "(?U)" + CODE, "specifications": gated(ANY_CASE, SPECIFICATIONS),
    }
    summary = any_of(F.lower(text), ["executive summary", "management summary"])
    return F.struct(*[matches(text, p).alias(n) for n, p in counts.items()], summary.alias("summary"), fiscal_year(text).alias("fiscal_year"))


def confidences(s: Column) -> dict[str, Column]:
    """``business, academic, legal, technical`` from :func:`signals`."""
    return {
        "business": business_confidence(s["sections"], s["metrics"], s["companies"], s["summary"], s["fiscal_year"].isNotNull()),
        "academic": F.least(F.round(s["citations"] * 0.2 + s["headings"] * 0.15, 6), F.lit(1.0)),
        "legal": F.least(F.round((s["clauses"] + s["terms"]) * 0.1, 6), F.lit(1.0)),
        "technical": F.least(F.round((s["code"] + s["specifications"]) * 0.1, 6), F.lit(1.0)),
    }


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, as a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def category_of(business: Column, academic: Column, legal: Column, technical: Column) -> Column:
    return (
        F.when((business >= 0.6) & (business >= academic), "Business")
        .when((academic >= 0.7) & (academic >= business), "Academic")
        .when(legal >= 0.5, "Legal")
        .when(technical >= 0.5, "Technical")
        .otherwise("Mixed")
    )


def category(text: Column) -> Column:
    return bound(signals(text), lambda s: bound(F.struct(*[c.alias(n) for n, c in confidences(s).items()]), lambda c: category_of(c["business"], c["academic"], c["legal"], c["technical"])))


def financial_number(text: Column) -> Column:
    """A number in European or American writing: at most two digits after the last comma or dot are decimals."""
    plain = F.translate(text, "  ", "")
    european = F.rlike(plain, F.lit(r",[0-9]{0,2}$"))
    american = F.rlike(plain, F.lit(r"\.[0-9]{0,2}$"))
    digits = (
        F.when(european, F.translate(F.translate(plain, ".", ""), ",", "."))
        .when(american, F.translate(plain, ",", ""))
        .otherwise(F.translate(plain, ",.", ""))
    )
    return digits.try_cast("double")


def scaled_value(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return (
        F.when(u.isin("million", "millions", "m"), value * 1e6)
        .when(u.isin("billion", "billions", "milliard", "milliards", "b", "md"), value * 1e9)
        .when(u.isin("thousand", "k"), value * 1e3)
        .otherwise(value)
    )


def unit_name(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("million", "m"), "Million").when(u.isin("billion", "b"), "Billion").when(u.isin("thousand", "k"), "Thousand").when(u == "%", "Percent").otherwise("Units")


def currency(text: Column) -> Column:
    found = F.regexp_extract(text, ANY_CASE + CURRENCY, 1)
    return F.when(found == "$", "USD").when(found == "€", "EUR").when(found == "£", "GBP").when(found == "¥", "JPY").when(found != "", found)


def kpis(text: Column, period: Column) -> Column:
    """``array<struct<name, value, currency, period, unit>>``: the first match of each indicator, in the listed order."""
    out = []
    for name, head in KPIS.items():
        pattern = f"{ANY_CASE}{head}\\s*{MONEY}\\s*{NUMBER}\\s*{SCALE}"
        number, unit = financial_number(F.regexp_extract(text, pattern, 2)), F.regexp_extract(text, pattern, 3)
        found = F.struct(
            F.lit(name).alias("name"), scaled_value(number, unit).alias("value"), F.coalesce(currency(text), F.lit("USD")).alias("currency"),
            F.coalesce(period.cast("string"), F.lit("Unknown")).alias("period"), unit_name(unit).alias("unit"),
        )
        out.append(F.when(number.isNotNull(), found))
    return F.filter(F.array(*out), lambda k: k.isNotNull())


def first_of(text: Column, patterns: dict[str, str], default: str | None) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(patterns.items()):
        out = F.when(F.rlike(text, F.lit(ANY_CASE + pattern)), name).otherwise(out)
    return out


def business_metadata(text: Column, year: Column) -> Column:
    """``struct<fiscal_year, company, sector, section, kpis, confidence>``."""
    found, section = kpis(text, year), first_of(text, SECTIONS, "Unknown")
    company = F.nullif(F.trim(F.regexp_extract(text, ANY_CASE + COMPANY_NAME, 1)), F.lit(""))
    by_section = F.when(section.isin("ExecutiveSummary", "FinancialHighlights"), 0.3).when(section == "BusinessOverview", 0.2).when(section == "Unknown", 0.0).otherwise(0.1)
    confidence = F.least(F.least(F.size(found) * 0.2, F.lit(0.8)) + by_section + F.when(company.isNotNull(), 0.2).otherwise(0.0), F.lit(1.0))
    return F.struct(
        year.alias("fiscal_year"), company.alias("company"), first_of(text, SECTORS, None).alias("sector"), section.alias("section"),
        found.alias("kpis"), F.round(confidence, 6).alias("confidence"),
    )


def domain_intent(query: Column) -> Column:
    """The domain with the most terms in the query; ties in the listed order; General without any."""
    low = F.lower(query)
    counts = {name: hits(low, terms) for name, terms in DOMAIN_TERMS.items()}
    top = F.greatest(*counts.values())
    out = F.lit("General")
    for name, n in reversed(counts.items()):
        out = F.when((n == top) & (top > 0), name).otherwise(out)
    return out


def strong_legal_hits(text: Column) -> Column:
    total = F.lit(0)
    for p in STRONG_LEGAL:
        total = total + matches(text, gated("(?iU)", p))
    return total


def search_intent(query: Column, high_idf: Column, n_tokens: Column) -> Column:
    """ExactPhrase, Conceptual or Mixed; ``high_idf``: whether a leading term's inverse document frequency is over 2.5."""
    exact = F.contains(query, F.lit('"')) | F.rlike(query, F.lit(r"\b\d+x\b|v\d+|\d+%"))
    concept = any_of(F.lower(query), CONCEPTUAL)
    return (
        F.when(exact | (high_idf & ((n_tokens <= 3) | ~concept)), "ExactPhrase").when(concept & ~high_idf, "Conceptual").otherwise("Mixed")
    )


def user_intention(query: Column) -> Column:
    """``struct<intention, confidence>``; ties in the listed order."""
    words = F.greatest(word_count(query), F.lit(1))
    best = F.struct(F.lit(0.5).alias("confidence"), F.lit("General").alias("intention"))
    top = F.lit(0.0)
    scores = {}
    for name, patterns in USER_INTENTIONS.items():
        n = sum((F.rlike(query, F.lit(ANY_CASE + p)).cast("int") for p in patterns), F.lit(0))
        scores[name] = F.round(n / len(patterns) * 0.8 + n / words * 0.2, 6)
        top = F.greatest(top, scores[name])
    out = best
    for name, s in reversed(scores.items()):
        out = F.when((s == top) & (top > 0), F.struct(F.least(s, F.lit(1.0)).alias("confidence"), F.lit(name).alias("intention"))).otherwise(out)
    return out


def has_figure_reference(text: Column) -> Column:
    low = F.lower(text)
    return any_of(low, FIGURE_WORDS) & any_of(low, DATA_WORDS)


def page_type(method: Column, content: Column) -> Column:
    low = F.lower(content)
    by_text = F.when(any_of(low, COMMERCE_WORDS), "commerce").when(any_of(low, ARTICLE_WORDS), "article").otherwise("generic")
    out = F.when(F.contains(method, F.lit("intelligent")), by_text).otherwise("generic")
    for word, name in (("email", "email_like"), ("table", "table_dataset"), ("article", "article"), ("commerce", "commerce")):
        out = F.when(F.contains(method, F.lit(word)), name).otherwise(out)
    return out


def prices(text: Column) -> Column:
    """Distinct prices, pattern after pattern, in order."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PRICES]))


def blocked_domain(url: Column) -> Column:
    return any_of(F.lower(url), BLOCKED_DOMAINS)


def filename_category(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("facture")), "facture").when(F.contains(low, F.lit("contrat")), "contrat").when(F.contains(low, F.lit("rapport")), "rapport").when(F.contains(low, F.lit("manuel")), "manuel").otherwise("document")


# Ways of carrying out an intention with milliseconds and whether the web is searched, and further actions.
STRATEGIES = {
    "Summary": ("Local LLM summarization", 2000, False), "Search": ("Web search + fact checking", 5000, True),
    "Recommendation": ("Context analysis + action planning", 3000, False), "Translation": ("Language detection + translation", 1500, False),
    "Explanation": ("Knowledge retrieval + explanation", 4000, True), "General": ("General analysis", 2500, False),
}
ACTIONS = {"Summary": "export_note", "Search": "open_sources", "Recommendation": "create_tasks"}
NO_TEXT = "Aucun contenu textuel disponible"


def relevant_content(selection: Column, fulltext: Column, completeness: Column, intention: Column) -> Column:
    """A selection of more than 50 bytes; else a complete text, cut for some intentions; else any selection; else the text's start."""
    cut = F.when(intention.isin("Summary", "Translation") & (F.octet_length(fulltext) > 2000), F.concat(F.substring(fulltext, 1, 2000), F.lit("..."))).otherwise(fulltext)
    start = F.when(F.octet_length(fulltext) > 500, F.concat(F.substring(fulltext, 1, 500), F.lit("..."))).otherwise(fulltext)
    return (
        F.when(F.octet_length(F.trim(selection)) > 50, selection)
        .when(fulltext.isNotNull() & (completeness > 0.8), cut)
        .when(F.trim(selection) != "", selection)
        .when(fulltext.isNotNull(), start)
        .otherwise(NO_TEXT)
    )


def strategy(intention: Column) -> Column:
    """``struct<approach, duration_ms, web_search>``."""

    def of(name: str) -> Column:
        approach, duration, web = STRATEGIES[name]
        return F.struct(F.lit(approach).alias("approach"), F.lit(duration).alias("duration_ms"), F.lit(web).alias("web_search"))

    out = of("General")
    for name in STRATEGIES:
        out = F.when(intention == name, of(name)).otherwise(out)
    return out


def suggested_actions(intention: Column, app: Column, document_type: Column) -> Column:
    """Names of actions: copying, what the intention asks for, and what the application and the document allow."""
    by_intention = F.lit(None).cast("string")
    for name, action in ACTIONS.items():
        by_intention = F.when(intention == name, action).otherwise(by_intention)
    listed = F.array(F.lit("copy"), by_intention, F.when(any_of(app, ("Word", "Pages")), "insert_document"), F.when(document_type == "web", "bookmark"))
    return F.filter(listed, lambda a: a.isNotNull())


# What each kind of page is headed by and what is asked about it.
PAGE_FORMS = {
    "commerce": (
        "📄 **CONTENU:**\n",
        "**MISSION:** Analyse ces informations commerciales. Identifie les meilleurs prix, compare les offres, et donne des conseils d'achat concrets basés sur les données extraites.",
    ),
    "article": (
        "📰 **ARTICLE:**\n",
        "**MISSION:** Résume cet article en 5 points clés, extrais 3 citations importantes, et génère 3 questions critiques pour approfondir le sujet.",
    ),
    "table_dataset": (
        "📊 **DONNÉES TABULAIRES:**\n",
        "**MISSION:** Analyse ces données structurées. Identifie 3 insights clés, détecte 2 valeurs aberrantes potentielles, et propose une synthèse actionnable.",
    ),
    "email_like": (
        "📧 **CONTENU EMAIL/MESSAGE:**\n",
        "**MISSION:** Résume ce message, extrais les action items et deadlines, identifie les contacts importants et propose un plan de suivi.",
    ),
}
GENERIC_FORM = "**Question à propos de ce contenu :** "


def page_form(kind: Column, source: Column, title: Column, url: Column, content: Column) -> Column:
    """A page's content under the heading of its kind, with what is asked about it; commerce lists its first five prices."""
    head = F.concat(source, F.lit(" extrait de **"), title, F.lit("**\n🔗 "), url, F.lit("\n\n"))
    found = F.slice(prices(content), 1, 5)
    listed = F.array_join(F.transform(found, lambda p: F.concat(F.lit("• "), p, F.lit("\n"))), "")
    offers = F.when(F.size(found) > 0, F.concat(F.lit("💰 **PRIX DÉTECTÉS:**\n"), listed, F.lit("\n"))).otherwise("")
    out = F.concat(head, content, F.lit("\n\n" + GENERIC_FORM))
    for name, (heading, asked) in PAGE_FORMS.items():
        form = F.concat(head, offers if name == "commerce" else F.lit(""), F.lit(heading), content, F.lit("\n\n" + asked))
        out = F.when(kind == name, form).otherwise(out)
    return out
