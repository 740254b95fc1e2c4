"""Vehicles and their parts as people write them: brand groups, engines, part names in three languages."""

from __future__ import annotations

import functools

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .bulletins import comparable
from .scoring import clean

#: The group whose fault-code dictionary a brand shares.
BRAND_GROUPS = {
    "VAG": ("Volkswagen", "VW", "Škoda", "Skoda", "Audi", "Seat", "SEAT", "Cupra", "CUPRA"),
    "BMW": ("BMW", "MINI", "Mini"),
    "MB": ("Mercedes-Benz", "Mercedes", "Smart"),
    "FORD": ("Ford", "Ford (US)", "Lincoln"),
    "TOYOTA": ("Toyota", "Toyota (US)", "Lexus"),
    "RENAULT": ("Renault", "Dacia"),
    "PSA": ("Peugeot", "Citroën", "Citroen", "Opel"),
    "FIAT": ("Fiat", "Alfa Romeo", "Lancia"),
    "NISSAN": ("Nissan", "Nissan (US)", "Infiniti"),
    "HYUKIA": ("Hyundai", "Hyundai (US)", "Kia", "Kia (US)", "Genesis"),
    "GM": ("Chevrolet", "GMC", "Cadillac", "Buick"),
    "MOPAR": ("Ram", "Jeep", "Dodge", "Chrysler"),
    "HONDA": ("Honda", "Acura"),
    "SUBARU": ("Subaru",),
    "MAZDA": ("Mazda",),
    "SUZUKI": ("Suzuki",),
    "VOLVO": ("Volvo",),
    "TESLA": ("Tesla",),
}
#: Models of makers of cars that are trucks.
COMMERCIAL = {
    "VOLVO": (r"VN", r"VNL(?: \(\d+\))?", r"VNR(?: \(\d+\))?", r"VNRE(?: \(ELECTRIC\))?", r"VHD", r"VAH", r"VT"),
    "ISUZU": (r"N-SERIES", r"F-SERIES", r"F SERIES", r"H SERIES", r"T SERIES"),
}
#: Marks of fuels in the engine names of manuals, in upper case.
ENGINE_FUELS = (("diesel", "TDI|SDI|CDI|HDI|CRDI|JTD|CDTI|D4D"), ("petrol", "TSI|TFSI|FSI|MPI|VTEC|GDI|T-GDI|MIVEC"))
#: Names of parts and what they are called in manuals.
PARTS = {
    "turbocharger": ("turbodmychadlo", "turbína", "turbo", "turbolader"),
    "oil pump": ("olejové čerpadlo", "ölpumpe"),
    "oil filter": ("olejový filtr", "ölfilter"),
    "oil sump": ("olejová vana",),
    "cylinder head": ("hlava válců", "hlavy válců", "zylinderkopf"),
    "water pump": ("vodní čerpadlo", "vodní pumpa", "wasserpumpe"),
    "thermostat": ("termostat",),
    "radiator": ("chladič", "kühler"),
    "intercooler": ("mezichladič", "ladeluftkühler"),
    "oil cooler": ("chladič oleje",),
    "timing belt": ("rozvodový řemen", "rozvody", "zahnriemen"),
    "crankshaft": ("klikový hřídel", "kliková hřídel", "kurbelwelle"),
    "camshaft": ("vačkový hřídel", "nockenwelle"),
    "injector": ("vstřikovač", "vstřikovače", "einspritzdüse"),
    "glow plug": ("žhavicí svíčka", "žhavicí svíčky", "glühkerze"),
    "spark plug": ("zapalovací svíčka", "zapalovací svíčky", "zündkerze"),
    "fuel filter": ("palivový filtr", "kraftstofffilter"),
    "fuel pump": ("palivové čerpadlo",),
    "clutch": ("spojka", "kupplung"),
    "flywheel": ("setrvačník", "schwungrad"),
    "dual-mass flywheel": ("dvouhmotový setrvačník",),
    "exhaust": ("výfuk", "auspuff"),
    "catalytic converter": ("katalyzátor", "katalysator"),
    "lambda probe": ("lambda sonda",),
    "air conditioning": ("klimatizace", "klimaanlage"),
    "alternator": ("alternátor", "lichtmaschine"),
    "starter": ("startér", "anlasser"),
    "steering": ("řízení", "lenkung"),
    "brakes": ("brzdy", "bremsen"),
    "brake pads": ("brzdové destičky",),
    "EGR valve": ("egr ventil",),
    "air filter": ("vzduchový filtr", "vzduchový filtr motoru", "luftfilter"),
    "MAF sensor": ("snímač maf", "maf senzor", "snímač hmotnostního průtoku", "maf sensor"),
    "MAP sensor": ("snímač map", "map senzor", "snímač tlaku sání", "map sensor"),
    "intake manifold": ("sacím potrubí", "sací potrubí", "saugrohr"),
    "NOx sensor": ("snímač nox", "měrný článek nox"),
    "AdBlue pump": ("adblue čerpadlo",),
    "AdBlue dosing valve": ("dávkovací ventil adblue",),
    "SCR catalyst": ("scr katalyzátor",),
    "DPF filter": ("dpf filtr", "filtr pevných částic"),
    "exhaust temperature sensor": ("snímač teploty výfuku",),
    "throttle body": ("škrtící klapka", "škrtici klapka", "drosselklappe"),
    "high-pressure fuel pump": ("vysokotlaké čerpadlo",),
    "injection pump": ("vstřikovací čerpadlo",),
    "crankshaft position sensor": ("snímač polohy klikového hřídele",),
    "camshaft position sensor": ("snímač polohy vačkového hřídele",),
    "coolant temperature sensor": ("snímač teploty chladiva",),
    "boost pressure sensor": ("snímač tlaku turba", "snímač plnícího tlaku"),
}
#: The repair group in which manuals of one maker treat a part.
REPAIR_GROUPS = {
    "13": ("crankshaft", "flywheel", "timing belt", "crankshaft position sensor"),
    "15": ("cylinder head", "camshaft", "valve", "spark plug", "camshaft position sensor"),
    "17": ("oil pump", "oil filter", "oil sump", "oil cooler"),
    "19": ("water pump", "thermostat", "radiator", "coolant", "coolant temperature sensor"),
    "20": ("fuel filter", "fuel pump", "high-pressure fuel pump", "injection pump"),
    "21": ("turbocharger", "intercooler", "boost pressure sensor", "turbocharger boost"),
    "23": ("injector", "injection"),
    "24": ("air filter", "MAF sensor", "MAP sensor", "intake manifold", "throttle body"),
    "26": ("exhaust", "catalytic converter", "EGR valve", "NOx sensor", "SCR catalyst", "AdBlue pump", "AdBlue dosing valve", "DPF filter", "exhaust temperature sensor", "lambda probe"),
    "28": ("glow plug",),
    "30": ("clutch",),
    "44": ("steering",),
    "46": ("brakes", "brake pads"),
    "87": ("air conditioning",),
    "90": ("alternator", "starter"),
}


def _table(of: dict[str, tuple[str, ...]]) -> Column:
    """name to key of a dictionary of names, as a literal map."""
    return F.create_map(*(F.lit(x) for key, names in of.items() for name in names for x in (name, key)))


def brand_group(brand: Column) -> Column:
    """Null for a brand of no group."""
    return F.try_element_at(_table(BRAND_GROUPS), brand)


def commercial_model(make: Column, model: Column) -> Column:
    """Whether a model of a maker of cars is a truck."""
    key, name = comparable(make), F.upper(clean(model))
    out = F.lit(False)
    for maker, shapes in COMMERCIAL.items():
        out = out | ((key == maker) & name.rlike(rf"^(?:{'|'.join(shapes)})$"))
    return F.coalesce(out, F.lit(False))


def plain_model(model: Column) -> Column:
    """A model's name without generation, platform and years."""
    t = model
    for shape in (r"\s*\(.*?\)", r"\s+B\d\b", r"(?i)\s+Mk\s*\d+", r"\s+[IVX]{1,4}\b", r"\s+\d{4}\s*[–-]?\s*\d{0,4}"):
        t = F.regexp_replace(t, shape, "")
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def engine_hints(engine: Column) -> Column:
    """struct<kw, displacement, fuel> of what an engine's name says."""
    kw = F.regexp_extract(engine, r"(?i)(\d{1,9})\s*kW", 1).try_cast("int")
    litres = F.concat_ws(".", F.nullif(F.regexp_extract(engine, r"(\d)[.,](\d)", 1), F.lit("")), F.nullif(F.regexp_extract(engine, r"(\d)[.,](\d)", 2), F.lit(""))).try_cast("double")
    fuel = F
    for name, marks in ENGINE_FUELS:
        fuel = fuel.when(F.upper(engine).rlike(marks), name)
    return F.struct(kw.alias("kw"), litres.alias("displacement"), fuel.otherwise(None).alias("fuel"))


def part_name(term: Column) -> Column:
    """A part's name in manuals; any other term as it is."""
    return F.coalesce(F.try_element_at(_table(PARTS), F.trim(F.lower(term))), term)


@functools.cache
def _part_names() -> ahocorasick.Automaton:
    """A trie of all names of parts, which finds those in a text in one walk."""
    found: dict[str, set[str]] = {}
    for key, names in PARTS.items():
        for name in (*names, key):
            found.setdefault(name.lower(), set()).add(key)
    trie = ahocorasick.Automaton()
    for name, keys in found.items():
        trie.add_word(name, tuple(keys))
    trie.make_automaton()
    return trie


@F.pandas_udf(ArrayType(StringType()))
def _parts_in(texts: pd.Series) -> pd.Series:
    trie = _part_names()
    return texts.map(lambda t: sorted({k for _, keys in trie.iter(t) for k in keys}) if t else [])


def parts_named(fault: Column) -> Column:
    """Names in manuals of the parts a fault's name mentions, sorted."""
    return _parts_in(F.lower(F.coalesce(fault, F.lit(""))))


def repair_group(part: Column) -> Column:
    """The repair group that manuals treat a part in, null if it has none."""
    return F.try_element_at(_table(REPAIR_GROUPS), part)


def mileage_number(text: Column) -> Column:
    """The digits of a mileage as a number; null without any text, 0 without digits in it."""
    s = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(s != "", F.coalesce(F.regexp_replace(s, "[^0-9]+", "").try_cast("long"), F.lit(0)))


def without_identity(case: Column) -> Column:
    """A case (struct with vehicle) without what identifies the single vehicle."""
    return case.withField("vehicle", case["vehicle"].dropFields("identType", "identValue"))


#: Words of an engine's name by technology, the urea system's, makers of electric cars only, and makers who share another's codes.
ENGINE_TECH = {
    "diesel": r"\b(?:TDI|HDi|CDI|dCi|CRDi|D-4D|MultiJet|BlueHDi|JTD|JTDM|Duratorq|EcoBlue|2\.0d|3\.0d|1\.5d|1\.6d|2\.2d|Duramax|Cummins|EcoDiesel|PowerStroke|Power Stroke|Diesel)\b",
    "turbo": r"\b(?:TSI|TFSI|T-GDI|TCe|THP|PureTech|T-Jet|Turbo|EcoBoost|N[0-9]{2}[A-Z]?|B[0-9]{2}[A-Z]?|FireFly T|DIG-T|MultiAir|SkyActiv Turbo|VC-Turbo|Hurricane|Twin Turbo|TwinTurbo|Supercharged|Hellcat|Redeye|Blackwing|EcoTec Turbo)\b",
    "electric": r"\b(?:Electric|EV|BEV|e-tron|iD|ID\.|e-208|e-C4|Niro EV|IONIQ|Model [3SXY]|e-Ducato|e-Berlingo|Electrified|Dual Motor|Single Motor|Mach-E)\b",
    "hybrid": r"\b(?:Hybrid|PHEV|HEV|GTE|e-TSI|e-HDi|E-TECH|PlugIn|Plug-In|eTorque|4xe|i-MMD|e-Boxer|IMA|Sport Hybrid|SH-AWD Hybrid|FHEV)\b",
}
UREA = r"\b(?:AdBlue|DEF|SCR|BlueTEC|BlueHDi|Reductant|Urea|NOx)\b"
ELECTRIC_ONLY = ("Tesla",)
CODES_OF = {
    "Ford (US)": "Ford", "Toyota (US)": "Toyota", "Nissan (US)": "Nissan", "Hyundai (US)": "Hyundai", "Kia (US)": "Kia", "Volkswagen (US)": "Volkswagen", "Pontiac": "Chevrolet", "Saturn": "Chevrolet", "SEAT": "Volkswagen", "Seat": "Volkswagen", "Cupra": "Volkswagen", "CUPRA": "Volkswagen", "Opel": "Peugeot",
}


def engine_tech(brand: Column, engine_power: Column) -> Column:
    """Technologies of an engine by its name, in order; urea counts for a diesel only."""
    power = F.coalesce(engine_power, F.lit(""))
    named = {n: power.rlike(f"(?i){p}") for n, p in ENGINE_TECH.items()}
    named["adblue"] = named["diesel"] & power.rlike(f"(?i){UREA}")
    tags = F.array_compact(F.array(*(F.when(holds, n) for n, holds in named.items())))
    return F.when(F.coalesce(brand, F.lit("")).isin(*ELECTRIC_ONLY), F.array(F.lit("electric"))).otherwise(tags)


def codes_brand(brand: Column) -> Column:
    """The maker in whose list a brand's codes stand."""
    return F.coalesce(*(F.when(brand == b, o) for b, o in CODES_OF.items()), brand)
