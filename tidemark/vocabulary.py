"""Vocabularies as data, and the rules that turn them into patterns valid in java.util.regex and in RE2.

Terms are plain phrases: a blank stands for any white space, a hyphen for a blank, a hyphen or nothing, and (s) for a plural.
A core is a pattern without word boundaries; rules of several words are made of word sets and distances.
"""

from __future__ import annotations

import re

WORD_CHARS = r"\p{L}\p{N}_"


def exists(*cores: str, tail: str = "", case: bool = False) -> str:
    """A pattern that holds where any of `cores` stands as whole words; `tail` adds characters that may not follow."""
    return rf"{'' if case else '(?i)'}(^|[^{WORD_CHARS}])(?:{'|'.join(cores)})([^{WORD_CHARS}{tail}]|$)"


def located(core: str, tail: str = "-") -> str:
    """A pattern whose whole match is the term: boundaries by look-around; characters of `tail` may not follow."""
    return rf"(?i)(?<![{WORD_CHARS}])(?:{core})(?![{WORD_CHARS}{tail}])"


def core(phrase: str) -> str:
    """The core of a plain phrase; a * at its end stands for any ending."""
    out = re.escape(phrase).replace(r"\(s\)", "s?").replace(r"\ ", r"\s+").replace(r"\-", r"[\s-]?")
    return out[:-2] + rf"[{WORD_CHARS}]*" if out.endswith(r"\*") else out


def literal(pattern: str) -> str:
    """The longest run of letters that every match of a core holds in lower case; empty if the core is an alternation."""
    bare = re.sub(r"\(\?:[^()]*\)[?*]?", " ", pattern)
    if "|" in bare or "(" in bare:
        return ""
    bare = re.sub(r"\[[^\]]*\]([?*+]|\{[^}]*\})?|\\[a-zA-Z]([?*+]|\{[^}]*\})?|.[?*]|\W", " ", bare)
    return max(bare.lower().split(), key=len, default="")


class Core(str):
    """A core that knows some stems, of which every match holds one in lower case."""

    stems: tuple[str, ...]

    def __new__(cls, pattern: str, stems: list[str]) -> Core:
        made = super().__new__(cls, pattern)
        made.stems = tuple(sorted(set(stems)))
        return made


def _stems(phrases: list[str]) -> list[str]:
    """The longest word of each phrase, without endings that may differ."""
    return [max(re.split(r"[ -]", p.lower().replace("(s)", "").rstrip("*")), key=len) for p in phrases]


def any_of(phrases: list[str]) -> Core:
    """One core for all of `phrases`, longer ones first."""
    return Core("(?:" + "|".join(core(p) for p in sorted(phrases, key=len, reverse=True)) + ")", _stems(phrases))


def rule(*parts: list[str] | int) -> Core:
    """Word sets in a row: next to each other, or with at most as many characters between them as the number between two sets
    says (-1: any distance). Its stems are those of the set with the longest words."""
    out, gap, stems = "", r"\s+", [""]
    for part in parts:
        if isinstance(part, int):
            gap = rf"(?:[^{WORD_CHARS}]|[^{WORD_CHARS}].{f'{{0,{part}}}' if part >= 0 else '*'}[^{WORD_CHARS}])"
            continue
        one = any_of(part)
        out += (gap if out else "") + one
        stems = max(stems, list(one.stems), key=lambda x: min(map(len, x)))
        gap = r"\s+"
    return Core(out, stems)


def gate(cores: list[str]) -> list[str]:
    """Words of which a text holds one in lower case if any of `cores` stands in it; empty if that cannot be said."""
    stems: set[str] = set()
    for c in cores:
        own = c.stems if isinstance(c, Core) else (literal(c),)
        if not all(own):
            return []
        stems.update(own)
    return sorted(x for x in stems if not any(y != x and y in x for y in stems))


# Specific (hard) terms, in order of preference.
HARD_TERMS = [
    "generative AI", "GenAI", "large language model(s)", "LLM(s)", "GPT-3", "GPT-4", "GPT-5", "GPT", "ChatGPT", "foundation model(s)", "frontier model(s)", "transformer(s)", "multimodal AI", "multimodal model", "multimodal",
    "RAG", "retrieval-augmented generation", "vector database", "vector store", "vector search", "vector embedding", "embedding(s)", "semantic search", "knowledge graph", "knowledge base",
    "prompt engineering", "fine-tune", "fine-tuned", "fine-tuning", "RLHF", "LoRA", "instruction tuning", "MLOps", "LLMOps", "AIOps", "model serving", "model deployment", "model inference", "edge AI", "edge computing",
    "GPU cluster", "GPU compute", "GPU infrastructure", "TPU cluster", "TPU compute", "TPU infrastructure", "NPU cluster", "NPU compute", "NPU infrastructure",
    "GitHub Copilot", "Copilot", "Claude", "Gemini", "Llama 2", "Llama 3", "Llama 4", "Llama", "Mistral", "DALL-E", "Stable Diffusion", "Midjourney", "Sora", "LangChain", "LangGraph", "AutoGPT", "CrewAI", "function calling", "tool use", "tool calling",
]
# Vague (soft) terms, in order of preference.
SOFT_TERMS = [
    "artificial intelligence", "machine learning", "deep learning", "neural network(s)", "natural language processing", "computer vision", "AI", "ML", "DL", "NLP", "predictive analytics", "cognitive computing", "intelligent automation",
    "AI-powered", "AI-driven", "AI-enabled", "AI-first", "AI-native", "AI-augmented", "ML-based", "ML-powered", "chatbot(s)", "virtual assistant", "conversational AI", "recommendation system", "recommendation engine", "sentiment analysis",
    "fraud detection", "predictive maintenance", "robot(s)", "robotic(s)", "RPA", "hyperautomation", "intelligent", "automation",
]
# Terms that do not count as the first part of a hyphenated word.
NO_HYPHEN = ["LLM(s)", "RAG", "AI", "ML", "DL", "NLP"]
HARD, SOFT = [core(t) for t in HARD_TERMS], [core(t) for t in SOFT_TERMS]
#: A term's core and the characters that may not follow it.
TAILS = {core(t): "-" for t in NO_HYPHEN}
# Cues that change the confidence in a mention; the first word of an entry names it, all its forms count once.
IMPLEMENTATION_CUES = [["deploy", "deployed", "deploying"], ["implement", "implemented", "implementing"], ["integrate", "integrated", "integrating"], ["roll-out"], ["launch", "launched", "launching"], ["build", "building"], ["scale", "scaled", "scaling"], ["production"], ["inference"], ["serving"]]
ARTIFACT_CUES = [["model"], ["pipeline"], ["training"], ["fine-tuning"], ["embedding(s)"], ["vector"], ["token(s)"], ["prompt"], ["guardrails"], ["evaluation"], ["benchmark"], ["data scientist"], ["ML engineer"]]
MARKETING_CUES = [["leverage", "leveraging"], ["explore", "exploring", "exploration"], ["aspire", "aspiration"], ["commitment", "committed"], ["vision"], ["strategy"], ["roadmap"], ["principle(s)"], ["guideline(s)"], ["policy"], ["framework"], ["responsible AI"], ["AI ethics"], ["AI governance"]]
IMPLEMENTATION, ARTIFACT, MARKETING = ([any_of(forms) for forms in cues] for cues in (IMPLEMENTATION_CUES, ARTIFACT_CUES, MARKETING_CUES))
ESG_TYPES = ["sustainability", "esg", "csr", "responsible", "governance", "ethics"]
ESG_TEXT = ["sustainab", "esg", "csr"]
# What a short term needs beside it.
VALIDATORS = ["artificial intelligence", "machine learning", "deep learning", "neural network", "algorithm", "model training", "prediction", "automat", "intelligent system", "chatbot", "generative", "llm", "gpt", "autonomous", "analytics", "natural language", "computer vision", "data science", "cognitive", "transformer", "inference"]

# What makes a hit false: kinds of text that only look like it. Acronyms count in capitals only.
_AI = ["AI", "artificial*"]
FALSE_POSITIVE = {
    "codes": exists(r"AI[\s-]?\d+", r"\d+[\s-]?AI", any_of(["www"]) + rf"\.[^\s]*\.ai", r"AI\.(?:com|org|net|io)") + rf"|(?i)[#@.]AI([^{WORD_CHARS}]|$)",
    "acronyms": exists("SEAI", "KAI", "RAIL", "RAIN", "AIDS", "AIMS", "PAID", "MAIN", "GAIN", "PAIN", "SAID", "WAIT", "FAIL", case=True),
    "places": exists(any_of(["Dubai", "Bangkok", "Thai", "Thailand", "Hawaii", "Samurai", "Bonsai", "Shanghai", "Shangai", "Mumbai", "Chennai"])),
    "volumes": exists(r"\d+\.?\d*\s*(?:ML|DL)", r"ML\s*\d[\d.,]*", rule(["ML", "DL"], ["water", "waste", "emission(s)", "metric", "ton(s)", "gallon(s)", "liter(s)"]), rule(["ML", "DL"], ["of"], ["water", "waste", "emission(s)", "ton(s)", "gallon(s)", "liter(s)"]), rule(["ML", "DL"], -1, ["metric", "intensity", "measurement"])),
    "damage": rf"[#$%&*@^]{{3,}}|[A-Za-z0-9]{{40,}}|(^|[^{WORD_CHARS}])[bcdfghjklmnpqrstvwxz]{{5,}}([^{WORD_CHARS}]|$)",
    "boards": exists(rule(["BOD", "board of director(s)"], -1, ["composed", "experience", "knowledge"], -1, ["AI"]), rule(["director(s)"], -1, ["expertise", "experience", "knowledge"], -1, _AI), rule(["form the BOD", "BOD regulation(s)"], -1, ["AI"]), rule(["skill(s) gap"], -1, ["director(s)"], -1, ["AI"]), rule(["spouse(s)", "lineal", "descendant(s)", "ascendant(s)"], -1, _AI), r"(?:communication|media|security),?\s*AI,?\s*(?:and\s+)?(?:cloud|digital)"),
    "careers": exists(rule(["CEO", "CFO", "CTO", "COO", "founder", "president"], ["of", "at"]) + rf"\s+[{WORD_CHARS}]+\s*AI", rule(["career highlights", "joined the board", "board committee(s)"], -1, _AI), r"director\s+since\s+\d{4}" + rf"[^{WORD_CHARS}](?:.*[^{WORD_CHARS}])?AI"),
    "embedding": exists(rule(["embedding"], ["policy", "policies", "value(s)", "principle(s)", "practice(s)", "ESG", "sustainability", "diversity", "inclusion", "culture"]), rule(["embedded in"], ["our", "the"], ["culture", "organization", "strategy"])),
    "headers": exists("AI\\s+Company\\s+Business\\s+Overview", rule(["special report"], -1, ["AI company"])),
    "air_and_fair": exists(rule(["air"], ["quality", "pollution", "travel", "cargo", "freight", "conditioning", "transport"]), rule(["fair"], ["value", "market", "trade", "housing", "lending", "price"])),
}
#: Acronyms in capitals that are false unless the second pattern holds too.
FALSE_UNLESS = {
    "FAIR": (exists("FAIR", case=True), exists(rule(["FAIR"], ["AI", "algorithm(s)", "model(s)", "machine", "lending"]))),
    "AIR": (exists("AIR", case=True), exists(rule(["AIR"], -1, ["artificial", "intelligence", "AI-powered"]))),
}

# Robots and process automation, with and without learning.
_ROBOT = ["robot(s)", "robotics"]
ROBOT_AI = exists(rule(["AI-powered", "AI-driven", "AI-enabled", "ML-powered", "ML-driven", "ML-enabled", "intelligent-powered", "intelligent-driven", "intelligent-enabled", "autonomous", "cognitive"], _ROBOT), rule(_ROBOT, -1, ["machine learning", "neural network", "computer vision", "AI"]), rule(["machine learning", "AI", "deep learning"], -1, _ROBOT))
ROBOT_TRADITIONAL = exists(rule(["industrial", "manufacturing", "assembly", "warehouse"], _ROBOT), rule(["robotic"], ["arm(s)"]), rule(["pick-and-pack", "pick-pack", "picking-and-packing", "picking-packing"], _ROBOT))
# Words that make a robot a learning one where no rule of the two kinds holds.
ROBOT_HINTS = ["artificial intelligence", "machine learning", "neural", "autonomous", "cognitive", "intelligent", " ai ", " ml ", "computer vision", "deep learning", "predictive"]
RPA_GUARD = ["rpa", "robotic process"]
RPA_AI = exists(rule(["intelligent", "cognitive", "AI-powered"], ["RPA", "automation", "process automation"]), rule(["RPA"], -1, ["with", "using", "combined", "enhanced"], -1, ["AI", "ML", "machine learning"]), "hyperautomation")
RPA_NAMES = any_of(["RPA", "robotic process automation"])
RPA_LEARNING = exists(any_of(["AI", "ML", "intelligent", "cognitive", "machine learning"]))
RPA_RULES = exists(any_of(["rule-based automation"]))

# Denial (hard) and hypothetical or risk language (soft) around a term, as word sets and distances.
_TERM = ["AI", "ML", "GenAI", "artificial intelligence", "machine learning"]
_USE = ["use", "deploy", "leverage", "employ", "utilize", "rely on", "operate"]
_PLAN = ["plan(s)", "intent", "intention", "strategy", "strategic plan"]
_RISK = ["risk(s)", "harm(s)", "threat(s)", "concern(s)", "liability", "liabilities", "exposure(s)"]
_LAW = ["regulatory", "regulators", "legal", "compliance"]
NEGATION_HARD = [
    rule(["do not", "does not", "did not", "do not currently", "does not currently", "did not currently"], _USE, 40, _TERM), rule(_TERM, 40, ["is not", "are not", "is not currently", "are not currently"], ["used", "deployed", "employed", "leveraged", "integrated"]),
    rule(["no", "not", "no current", "not current"], _PLAN, ["to"], ["deploy", "implement", "use", "adopt", "integrate"], 40, _TERM), rule(["none of our", "none of the"], ["products", "services", "operations", "systems", "business", "businesses"], 40, _USE, 40, _TERM),
    rule(["absent", "without", "lacking", "absent any", "without any", "lacking any"], _TERM), rule(_TERM, 30, ["not"], ["material", "significant", "core", "substantial", "a significant"]),
]
NEGATION_SOFT = [
    rule(_TERM, 60, ["may", "could", "might", "can", "would"], ["pose", "create", "introduce", "present", "cause", "result in", "lead to"], 40, [*_RISK, "losses", "damage(s)", "adverse", "negative"]), rule(_RISK, ["associated", "related", "linked"], ["with", "to"], 40, _TERM),
    rule(["cannot"], ["guarantee", "ensure", "assure", "predict"], 60, _TERM), rule(["if", "should", "in the event that"], [*_TERM, "our AI"], 40, ["fail*", "malfunction*", "err*", "breach*", "violate*", "expose*"]), rule(["hypothetical", "hypothetically", "potential", "potentially"], 30, _TERM),
    rule(_TERM, 30, ["will not", "may not"], ["be", "become", "prove"]), rule(_LAW, ["uncertainty", "uncertainties", "risk(s)"], 40, _TERM), rule(_TERM, 40, _LAW, ["uncertainty", "uncertainties", "risk(s)", "exposure"]), rule(["bias", "biased", "biases"], ["in", "of", "within"], [*_TERM, "our model(s)", "algorithm(s)"]),
]

# The maturity ladder with its scores, forward-looking cues and groups of commitment with their weights. A stage or group counts
# where its words stand beside a term.
_NAME = ["AI", "GenAI", "generative AI", "artificial intelligence", "machine learning", "LLM(s)", "large language model(s)", "Copilot", "ChatGPT"]
_beside = lambda verbs, nouns: [rule(verbs, 25, _NAME), rule(_NAME, nouns)]
MATURITY = {
    "exploring": (0.2, [*_beside(["evaluat*", "consider*", "explor*", "investigat*", "assess*", "study*", "experiment*"], ["evaluation", "feasibility", "assessment", "opportunities", "potential"])]),
    "piloting": (0.4, [*_beside(["pilot*", "trial*", "test*", "POC", "proof-of-concept", "initial"], ["pilot(s)", "prototype(s)", "experiment(s)", "trial(s)"])]),
    "implementing": (0.6, [*_beside(["implement*", "deploy*", "roll-out", "rolled out", "integrat*", "launch*", "release*", "introduc*", "production"], ["implementation", "deployment", "integration", "system(s)"])]),
    "scaling": (0.8, [*_beside(["scal*", "expand*", "extend*", "enterprise-wide", "hundreds of", "thousands of"], ["scaling", "expansion", "at scale", "across all"])]),
    "optimizing": (1.0, ["AI[\\s-]?first", "AI[\\s-]?native", *_beside(["fully", "completely", "continuous*", "ongoing", "optimis*", "optimiz*"], ["transformation", "optimization", "excellence", "maturity", "centre of excellence", "center of excellence", "driven organization", "driven company"])]),
}
_DO = ["implement", "deploy", "invest", "launch", "develop", "adopt", "integrate", "scale", "expand", "build"]
FUTURE = [
    rule(["will", "plan to", "plans to", "planning to"], _DO), any_of(["intend(s) to", "expect(s) to", "expected to", "aim(s) to", "commit(s) to", "committed to"]), r"by\s+20(?:2[5-9]|3\d)", rule(["in next", "in the next", "in coming", "in the coming", "in following", "in the following"], ["year(s)", "quarter(s)", "month(s)"]),
    r"over\s+the\s+next\s+(?:\d+\s+)?(?:years?|months?)", r"20(?:2[5-9]|3\d)\s+(?:goals?|targets?|objectives?|priorities)", rule(_NAME, ["roadmap"]), rule(["strategic", "future", "upcoming", "planned", "multi-year", "long-term"], _NAME),
]
_MONEY = r"(?:[$€£]|(?:USD|EUR|GBP)\s?)\s?\d[\d.,]*"
_SPENT = ["invest*", "allocat*", "committed", "pledged", "dedicated", "budget", "spending"]
COMMITMENT = {
    "financial": (2.0, [Core(any_of(_SPENT) + rf"[^{WORD_CHARS}].{{0,20}}{_MONEY}.{{0,60}}[^{WORD_CHARS}]" + any_of(_NAME), _stems(_SPENT)), Core(any_of(_NAME) + rf"\s+(?:budget|investment|spending)\s+of\s+{_MONEY}", ["budget", "investment", "spending"])]),
    "strategic": (1.5, [rule(_NAME, 10, ["core", "key", "strategic", "top", "critical"], ["priority", "pillar"]), rule(["strategic", "key", "critical"], ["focus", "initiative", "priority"], 60, _NAME), rule(["committed to"], _NAME), rule(["board", "executive", "leadership"], ["commitment", "support"], ["to", "for"], _NAME)]),
    "resources": (1.5, [rule(["hire", "hired", "hiring"], 40, [*_NAME, "ML", "data"], ["engineer(s)", "scientist(s)", "expert(s)", "specialist(s)"]), rule(["building", "established", "expanding"], _NAME, ["team(s)", "lab(s)", "center", "centre", "capability"]), r"Chief\s+AI\s+Officer", rule(_NAME, ["center of excellence", "centre of excellence"])]),
    "general": (1.0, [rule(["committed to"], ["advancing", "developing", "deploying", "embracing"], _NAME), rule(_NAME, ["commitment", "dedication", "focus"]), rule(["accelerat*", "prioritiz*", "embrac*"], _NAME, ["adoption", "transformation"])]),
    "generative": (1.8, [rule(["deployed", "launched", "implemented", "scaled", "scaling"], 15, ["GenAI", "generative AI", "LLM(s)", "Copilot", "ChatGPT"]), rule(["enterprise-wide", "company-wide"], ["GenAI", "LLM(s)", "Copilot"]), rule(["GenAI", "LLM(s)"], ["production", "live", "operational", "use cases", "applications", "projects"])]),
}
# Sentiment words of our own; governance and truly negative terms are fixed values.
POSITIVE = {"improve": 0.5, "progress": 0.4, "steady": 0.3, "faster": 0.5, "broad": 0.2, "encouraging": 0.7, "rose": 0.3, "clear": 0.2, "approval": 0.3}
NEGATIVE = {"risk": -0.4, "risks": -0.5, "delays": -0.5, "defects": -0.4, "false": -0.3, "unusual": -0.2, "decline": -0.6, "incidents": -0.4, "friction": -0.3}
GOVERNANCE = ["responsible AI", "AI governance", "AI ethics", "AI risk management", "AI policy", "AI compliance", "AI oversight", "AI principles", "ethical AI", "trustworthy AI", "AI framework", "AI guidelines", "bias mitigation", "fairness", "transparency", "accountability", "AI safety", "guardrails", "model risk", "AI audit"]
TRULY_NEGATIVE = ["failed", "failure", "lawsuit", "litigation", "breach", "hack", "layoff", "job loss", "replace workers", "eliminate jobs", "harmful", "dangerous", "threat to", "concern about", "security incident", "data breach", "privacy violation"]
#: Taxonomies are a parameter of the classifier: (axis, code, domain, keywords, patterns). These are short ones of our own.
TAXONOMY = [
    ("a", "A1", "", ["strategy", "transformation", "plan"], [r"our\s+plan", r"further\s+hiring"]),
    ("a", "A2", "", ["operations", "maintenance", "automation", "logistics", "depots"], [r"supply\s+\w+", r"plant\s+managers?"]),
    ("a", "A3", "", ["customer", "chatbot", "service", "clients"], [r"service\s+(?:centre|hours)", r"customer\s+\w+"]),
    ("a", "A4", "", ["product", "platform", "release"], [r"internal\s+product", r"new\s+platform"]),
    ("a", "A5", "", ["data", "forecast", "analytics", "score"], [r"training\s+data", r"data\s+\w+"]),
    ("a", "A6", "", ["risk", "privacy", "audit", "fraud", "regulators"], [r"audit\s+committee", r"privacy\s+review"]),
    ("a", "A7", "", ["staff", "specialists", "hiring", "training"], [r"trained\s+on", r"skilled\s+\w+"]),
    ("b", "B1", "", ["machine learning", "predictive", "forecast", "score"], [r"predictive\s+\w+", r"anomaly\s+detection"]),
    ("b", "B2", "", ["deep learning", "neural network", "neural networks"], [r"neural\s+networks?", r"deep\s+learning"]),
    ("b", "B3", "", ["natural language processing", "translation", "text"], [r"natural\s+language", r"translation\s+service"]),
    ("b", "B4", "", ["generative", "llm", "large language models", "prompt"], [r"generative\s+ai", r"large\s+language\s+models?", r"llms?"]),
    ("b", "B5", "", ["vision", "image", "camera", "inspection"], [r"computer\s+vision", r"image\s+\w+"]),
    ("b", "B6", "", ["robotic", "robot", "agent", "agents"], [r"robotic\s+process", r"(?:virtual|ai)\s+agents?"]),
    ("b", "B7", "", ["gpu", "vector", "platform", "sensor", "engine"], [r"gpu\s+cluster", r"vector\s+search"]),
    ("b", "B8", "", ["ai", "artificial intelligence"], [r"artificial\s+intelligence", r"ai"]),
    ("eu", "E1", "Reasoning", ["knowledge base", "knowledge", "reasoning"], []),
    ("eu", "E2", "Planning", ["planning", "scheduling", "optimiser"], []),
    ("eu", "E3", "Learning", ["learning", "training", "neural", "model"], []),
    ("eu", "E4", "Communication", ["language", "translation", "chatbot", "text"], []),
    ("eu", "E5a", "Perception", ["vision", "image", "camera"], []),
    ("eu", "E5b", "Perception", ["speech", "audio", "voice"], []),
    ("eu", "E6a", "Integration", ["agent", "agents"], []),
    ("eu", "E6b", "Integration", ["robot", "robotic", "automation"], []),
    ("eu", "E6c", "Integration", ["vehicle", "fleet"], []),
    ("eu", "E7", "Services", ["analytics", "platform", "gpu", "service"], []),
    ("eu", "E8a", "Ethics", ["ethics", "fairly", "responsible", "privacy"], []),
    ("eu", "E8b", "Philosophy", ["consciousness"], []),
]
