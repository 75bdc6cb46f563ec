"""Mapping free-entered values to a canonical list: a trie of entries and alias paths, searched with a Levenshtein automaton.

The search gives every entry within a distance that depends on the value's length; which of them a value means is chosen after.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import EMPLOYMENT, EXPERIENCE
from ..runtime import spread, table
from .automata import Trie

#: Further ways to say an entry, in English, German and Spanish; of titles, what no rule below derives.
MORE = {
    "employment_type": {
        "full_time": "f/t|vollzeit|tiempo completo|jornada completa|full",
        "part_time": "p/t|teilzeit|medio tiempo|tiempo parcial|media jornada|part",
        "contract": "por contrato|contrato|freiberuflich|freelancer|independent contractor|auf vertrag",
        "temporary": "befristet|temporal|temporär|zeitarbeit|eventual",
        "internship": "pasantía|pasantia|praktikum|prácticas|trainee|summer internship",
    },
    "experience_level": {
        "intern": "praktikant|praktikantin|intern level|becario|pasante|trainee",
        "junior": "jr|entry lvl|berufseinsteiger|principiante|beginner|graduate|junior level",
        "mid": "intermediate|intermedio|mid career|midlevel|midsenior level|mittlere ebene",
        "senior": "sr|snr|experienced senior|berufserfahren senior|erfahren|sénior",
        "lead": "team lead|teamleiter|líder|lider|tech lead|lead level",
        "executive": "exec|vice president|direktor|director general|c level|president|c suite|geschäftsführer",
    },
    "title": {
        "Registered Nurse": "rn|registered nurse rn|enfermera registrada",
        "Licensed Practical Nurse": "lpn|lvn|licensed vocational practical nurse|licensed vocational nurse",
        "Nurse Practitioner": "np|family nurse practitioner",
        "Nursing Assistant": "cna|nurse aide|certified nursing assistant",
        "Software Developer": "software engineer|softwareentwickler|desarrollador de software",
        "Data Analyst": "data analytics specialist|datenanalyst|analista de datos",
        "Data Engineer": "big data engineer|data pipeline engineer",
        "Database Administrator": "dba",
        "Network Technician": "netzwerktechniker",
        "Help Desk Technician": "help desk support|it support technician",
        "Accountant": "staff accountant|accountant gl|contador|buchhalter",
        "Payroll Clerk": "payroll specialist|payroll administrative clerk",
        "Office Manager": "manager of office",
        "Administrative Assistant": "asistente administrativo",
        "Receptionist": "receptionist greeter|front desk receptionist|recepcionista",
        "Truck Driver": "cdl a driver|otr driver|tractor trailer driver|chofer de camion",
        "Delivery Driver": "route delivery driver|repartidor",
        "Warehouse Associate": "warehouse worker|lagermitarbeiter",
        "Forklift Operator": "fork lift operator|forklift driver|lift truck operator|montacarguista",
        "Electrician": "journeyman electrician|electricista|elektriker",
        "Plumber": "journeyman plumber|plomero|klempner",
        "Welder": "welder fabricator|mig tig welder|soldador|schweisser",
        "Carpenter": "finish carpenter|carpintero|zimmermann",
        "Machinist": "cnc machinist|machinist manual cnc|maschinist cnc",
        "Heating and Cooling Technician": "hvac technician|hvac r technician|heating cooling technician",
        "Elementary School Teacher": "elementary teacher|grade school teacher|maestra de primaria",
        "Special Education Teacher": "sped teacher",
        "Substitute Teacher": "guest substitute teacher",
        "Security Guard": "security officer|guardia de seguridad",
        "Cashier": "retail cashier|cashier checkout|cajero|kassierer",
        "Retail Sales Associate": "store sales associate|retail associate",
        "Store Manager": "retail store manager",
        "Customer Service Representative": "csr|kundenberater",
        "Cook": "line cook|prep cook|cocinero|koch",
        "Food Server": "server restaurant|waiter waitress|mesero|kellner",
        "Dishwasher": "dish washer|kitchen dishwasher|lavaplatos",
        "Housekeeper": "housekeeping attendant|room attendant housekeeper|ama de llaves",
        "Janitor": "custodian|janitorial worker|conserje",
        "Medical Assistant": "cma|certified medical assistant",
        "Dental Hygienist": "rdh",
        "Dental Assistant": "registered dental assistant|asistente dental",
        "Pharmacy Technician": "pharmacy technician cpht",
        "Physical Therapist": "physiotherapist|pt outpatient therapist",
        "Social Worker": "lmsw|licensed social worker|trabajadora social|sozialarbeiter",
        "Paralegal": "para legal|legal assistant paralegal|litigation paralegal",
        "Human Resources Specialist": "human resources generalist",
        "Recruiter": "technical recruiter|talent acquisition recruiter|reclutador",
        "Graphic Designer": "graphics designer|disenador grafico|grafikdesigner",
        "Civil Engineer": "ingeniero civil|bauingenieur",
        "Mechanical Engineer": "maschinenbauingenieur",
        "Quality Inspector": "quality control inspector|inspector de calidad",
        "Project Manager": "gerente de proyecto|projektleiter",
        "Auto Mechanic": "automotive technician|auto technician mechanic|mecanico automotriz|kfz mechaniker",
        "Bank Teller": "teller|universal teller|cajero bancario",
        "Loan Officer": "mortgage loan officer|lending officer",
        "Home Health Aide": "hha|home care aide|caregiver home health",
    },
}
#: Short forms of the words of titles.
SHORT = {
    "accountant": "acct", "administrative": "admin", "administrator": "admin", "assistant": "asst", "associate": "assoc", "auto": "automotive",
    "control": "qc", "coordinator": "coord", "customer": "cust", "database": "db", "delivery": "del", "dental": "dent", "developer": "dev",
    "education": "ed|educ", "elementary": "elem", "engineer": "engr|eng", "human": "h", "hygienist": "hyg", "licensed": "lic", "maintenance": "maint",
    "manager": "mgr", "marketing": "mktg", "mechanical": "mech", "medical": "med", "nursing": "nurs", "office": "ofc", "officer": "ofcr",
    "pharmacy": "pharm", "physical": "phys", "practitioner": "pract", "production": "prod", "project": "proj", "registered": "reg", "representative": "rep",
    "resources": "res", "service": "svc", "software": "sw", "special": "spec", "substitute": "sub", "supervisor": "supv", "teacher": "tchr",
    "technician": "tech", "warehouse": "whse",
}
#: Short forms of two words together.
SHORT_PAIRS = {"human resources": "hr", "help desk": "helpdesk", "quality control": "qc"}

#: Words around a title: ranks, shifts, terms and advertising.
_AROUND = re.compile(
    r"\(req\.? ?\d+\)|\((?:m/?[wfd]/?[dxf]?|f/m|all genders)\)|\$[\d,.]+k? (?:sign-?on )?bonus|sign-?on bonus|\b(?:days?|nights?|evenings?|weekends?)(?:/(?:days?|nights?|evenings?|weekends?))*\b"
    r"|\b[123](?:st|nd|rd) shift\b|\bprn\b|\bper diem\b|\bimmediate start\b|\burgently hiring\b|\bhiring now\b|\bnow hiring\b|\bapply (?:today|now)\b|\*+\w*\**|\bhot\b|\bnew\b$|!+",
    re.I,
)
_RANKS = re.compile(r"^(?:senior|sr|junior|jr|lead|principal|entry level|staff|head|chief)\b\.?\s+|[\s,]+(?:senior|sr|junior|jr|lead)\b\.?$|[\s,]+(?:i{1,3}|iv|v|[1-5])$", re.I)


def fold(value: str) -> str:
    """Words of the value: lower case, without accents, full stops and quotes; other marks part words."""
    s = unicodedata.normalize("NFKD", value.casefold().replace("ß", "ss"))
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    return " ".join(re.findall(r"[^\W_]+", re.sub(r"[.'’`]", "", s)))


def bound(word: str) -> int:
    """How many edits a value may be from an entry: none up to 3 letters, one up to 8, two beyond."""
    n = len(word)
    return 0 if n <= 3 else 1 if n <= 8 else 2


def written(entry: str) -> set[str]:
    """The entry with each of its words in full or in a short form."""
    forms = {entry}
    for full, short in SHORT_PAIRS.items():
        if full in entry:
            forms.add(entry.replace(full, short))
    out = set()
    for f in forms:
        out |= {" ".join(w) for w in itertools.product(*[[w, *SHORT.get(w, "").split("|")] if w in SHORT else [w] for w in f.split()])}
    return out


#: Aliases: (field, alias, canonical entry, decides alone).
Alias = tuple[str, str, str, bool]


def own_aliases() -> list[Alias]:
    """The aliases of this project's lists: those of the alias maps of types and levels decide alone."""
    out = [(f, a.replace("_", " "), name, True) for f, own in (("employment_type", EMPLOYMENT), ("experience_level", EXPERIENCE)) for name, aliases in own.items() for a in aliases]
    return out + [(f, a, name, False) for f, entries in MORE.items() for name, aliases in entries.items() for a in aliases.split("|")]


def build_trie(field: str, entries: Iterable[tuple[int, str]], aliases: Iterable[Alias]) -> tuple[Trie, dict[str, int]]:
    """A trie of the field's entries with all alias paths, and the map of words that decide alone. Aliases of entries that the
    list doesn't have are left out."""
    by_name = {name: vid for vid, name in entries}
    trie, fixed = Trie(), {}
    words: dict[str, set[str]] = {name: {fold(name.replace("_", " "))} for name in by_name}
    for f, alias, name, alone in aliases:
        if f != field or name not in by_name:
            continue
        if alone:
            fixed[fold(alias)] = by_name[name]
        words[name].add(fold(alias))
    for name, forms in words.items():
        for w in forms:
            for form in written(w) if field == "title" else {w}:
                trie.add(form, by_name[name])
    return trie, fixed


def cores(value: str, field: str) -> Iterator[str]:
    """What of the value may be the entry, the fullest first: as it is, without what stands around it, with two parts
    swapped, without its last or first part, each also without ranks."""
    whole = value.strip()
    if field == "employment_type":
        whole = re.sub(r"^n(?=')", "", whole.lower())
    yield fold(whole)
    bare = re.sub(r"\(\s*\)", " ", _AROUND.sub(" ", whole)).strip()
    if field != "title":
        yield fold(re.sub(r"\([^()]*\)", " ", bare))
        return
    parts = [p.strip(" -–|,") for p in re.split(r"\s[-–—|]+\s|\s[-–—|]+$|^[-–—|]+\s", bare)]
    parts = [p for p in parts if p]
    bared = [unranked(p) for p in parts]

    def forms(ps: list[str]) -> Iterator[str]:
        text = " ".join(ps)
        yield fold(text)
        yield fold(re.sub(r"\([^()]*\)", " ", text))
        if len(ps) == 1 and text.count(",") == 1:
            yield fold(" ".join(reversed(text.split(","))))
        if len(ps) == 2:
            yield fold(f"{ps[1]} {ps[0]}")

    for k in range(len(parts), 0, -1):
        for ps in (parts[:k], bared[:k]):
            yield from forms([p for p in ps if p])
    if len(parts) > 1:
        yield from forms([p for p in bared[1:] if p])


def unranked(part: str) -> str:
    """The part without the ranks at its ends."""
    while (shorter := _RANKS.sub("", part, count=1).strip()) and shorter != part:
        part = shorter
    return part


def neighbours(core: str, trie: Trie) -> list[tuple[int, int]]:
    """(distance, entry) of every entry within the core's bound, the nearest first."""
    best: dict[int, int] = {}
    for vid, d in trie.within(core, bound(core)):
        best[vid] = min(d, best.get(vid, d))
    return sorted((d, vid) for vid, d in best.items())


#: A value's candidates: rank (0 is what the value means), entry, distance, and the part of the value that is near it.
Candidate = tuple[int, int, int, str]


class Matcher:
    """Finds all entries near a value; remembers cores, as many values share one."""

    def __init__(self, lists: dict[str, list[tuple[int, str]]], aliases: list[Alias] | None = None) -> None:
        aliases = own_aliases() if aliases is None else aliases
        self.tries = {f: build_trie(f, e, aliases) for f, e in lists.items()}
        self.find = lru_cache(200_000)(lambda field, core: neighbours(core, self.tries[field][0]))

    def candidates(self, field: str, value: str) -> list[Candidate]:
        """Every entry within bound() edits of some core of the value, once, the best first.

        The fullest core that decides alone or is an entry wins; then the entry of the least distance for its core's length,
        so that a short word beside the title doesn't beat the title; then the fuller core and the smaller id.
        """
        if field not in self.tries:
            return []
        trie, fixed = self.tries[field]
        best: dict[int, tuple] = {}
        for k, core in enumerate(dict.fromkeys(c for c in cores(value, field) if c)):
            found = [(0, fixed[core])] if core in fixed else [(0, v) for v in sorted(trie.exact(core))]
            sure = bool(found)
            found += [x for x in self.find(field, core) if x not in found]
            for d, vid in found:
                order = (0, k, vid) if sure and d == 0 else (1, d / len(core), k, vid)
                if vid not in best or order < best[vid][0]:
                    best[vid] = (order, d, core)
        return [(rank, vid, d, core) for rank, (vid, (_, d, core)) in enumerate(sorted(best.items(), key=lambda x: x[1][0]))]

    def match(self, field: str, value: str) -> int:
        """The id of the entry that the value means, or 0."""
        found = self.candidates(field, value)
        return found[0][1] if found else 0


CANDIDATES = "field_name string, value string, rank int, value_id long, distance int, part string"


def near_entries(values: DataFrame, canonical: DataFrame, aliases: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """CANDIDATES rows: for each distinct (field_name, value) every entry within the distance, rank 0 being the one it means.

    `canonical` (value_id, field_name, canonical) is the reference list; `aliases` (field_name, alias, canonical, alone) are
    other ways to say an entry, by default this project's own. Both go to every task, so their size is checked: beyond
    `most` rows this raises, as such a list needs to be sharded. Nulls are left out; a value that no entry is near has one row,
    without an entry, as has an empty text.
    """

    def bounded(df: DataFrame, what: str) -> list:
        rows = df.dropna().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} {what}")
        return sorted(tuple(r) for r in rows)

    lists: dict[str, list[tuple[int, str]]] = {}
    for vid, field, name in bounded(canonical.select("value_id", "field_name", "canonical"), "entries"):
        lists.setdefault(field, []).append((vid, name))
    others = None if aliases is None else bounded(aliases.select("field_name", "alias", "canonical", "alone"), "aliases")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(lists, others)
        for pdf in batches:
            rows = [(f, v, *c) for f, v in zip(pdf["field_name"], pdf["value"]) for c in (m.candidates(f, v) or [(0, None, None, None)])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")]).astype({"rank": "int32", "value_id": "Int64", "distance": "Int32"})

    return spread(values.select("field_name", "value").dropna().distinct(), "value").mapInPandas(match, CANDIDATES)


def map_values(values: DataFrame, canonical: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(field_name, value, value_id) for each distinct (field_name, value), chosen from near_entries(); 0 where no entry fits."""
    return near_entries(values, canonical, aliases).filter("rank = 0").select("field_name", "value", F.coalesce("value_id", F.lit(0)).cast("long").alias("value_id"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """The canonical entry of every title, employment type and experience level of `job_records`."""
    jr = table(spark, root, "job_records").select("job_id", "title", "employment_type", "experience_level")
    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("title", "employment_type", "experience_level")])
    long = jr.select("job_id", F.explode(pairs).alias("x")).select("job_id", "x.*").filter(F.col("value").isNotNull())
    return long.join(map_values(long, table(spark, root, "canonical_values")), ["field_name", "value"]).select("job_id", "field_name", "value_id")
