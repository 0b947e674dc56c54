"""Entity and relation vocabularies, canonical names, quantities."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

# Node types, type aliases, relations, verb phrases, verbs without meaning.
NODE_TYPES = [
    "Mission", "Satellite", "Sensor", "Instrument", "Band", "Channel", "Product", "Parameter", "Algorithm", "Unit", "Measurement", "Organization", "Location", "Event", "Orbit", "DataFormat", "Application", "Formula", "Concept",
]
TYPE_ALIASES = {
    "org": "Organization", "person": "Organization", "gpe": "Location", "loc": "Location", "fac": "Location", "event": "Event", "norp": "Organization", "work_of_art": "Concept", "satellite": "Satellite", "spacecraft": "Satellite",
    "mission": "Mission", "sensor": "Sensor", "instrument": "Instrument", "payload": "Instrument", "band": "Band", "channel": "Channel", "product": "Product", "dataset": "Product", "parameter": "Parameter", "variable": "Parameter",
    "geophysical parameter": "Parameter", "algorithm": "Algorithm", "model": "Algorithm", "unit": "Unit", "organization": "Organization", "agency": "Organization", "location": "Location", "region": "Location", "place": "Location",
    "orbit": "Orbit", "format": "DataFormat", "file format": "DataFormat", "application": "Application", "use case": "Application", "formula": "Formula", "equation": "Formula", "concept": "Concept",
}
RELATION_TYPES = [
    "CARRIES", "HAS_INSTRUMENT", "HAS_BAND", "HAS_CHANNEL", "PRODUCES", "MEASURES", "HAS_SPEC", "HAS_UNIT", "LAUNCHED_BY", "LAUNCHED_ON", "OPERATED_BY", "OPERATES_IN", "PART_OF", "DERIVED_FROM", "USES", "PROVIDES", "LOCATED_IN", "APPLIES_TO",
    "RELATED_TO", "MENTIONED_IN", "PART_OF_DOCUMENT",
]
VERB_TO_RELATION = {
    "carries": "CARRIES", "carry": "CARRIES", "carrying": "CARRIES", "onboard": "CARRIES", "on board": "CARRIES", "aboard": "CARRIES", "hosts": "CARRIES", "host": "CARRIES", "carries sensor": "CARRIES",
    "has instrument": "HAS_INSTRUMENT", "equipped with": "HAS_INSTRUMENT", "has band": "HAS_BAND", "has channel": "HAS_CHANNEL", "produces": "PRODUCES", "produce": "PRODUCES", "generates": "PRODUCES", "generate": "PRODUCES",
    "yields": "PRODUCES", "measures": "MEASURES", "measure": "MEASURES", "observes": "MEASURES", "observe": "MEASURES", "monitors": "MEASURES", "monitor": "MEASURES", "retrieves": "MEASURES", "retrieve": "MEASURES", "senses": "MEASURES",
    "estimates": "MEASURES", "launched by": "LAUNCHED_BY", "launched on": "LAUNCHED_ON", "launched": "LAUNCHED_ON", "operated by": "OPERATED_BY", "operated": "OPERATED_BY", "run by": "OPERATED_BY", "managed by": "OPERATED_BY",
    "operates in": "OPERATES_IN", "orbits": "OPERATES_IN", "part of": "PART_OF", "belongs to": "PART_OF", "belong to": "PART_OF", "derived from": "DERIVED_FROM", "derive": "DERIVED_FROM", "based on": "DERIVED_FROM", "uses": "USES",
    "use": "USES", "utilizes": "USES", "provides": "PROVIDES", "provide": "PROVIDES", "offers": "PROVIDES", "located in": "LOCATED_IN", "located": "LOCATED_IN", "situated in": "LOCATED_IN", "applies to": "APPLIES_TO",
    "used for": "APPLIES_TO", "applied to": "APPLIES_TO",
}
TRIVIAL = ["IS", "ARE", "WAS", "WERE", "BE", "BEEN", "BEING", "AM", "HAS", "HAVE", "HAD", "HAVING", "DO", "DOES", "DID", "DONE", "S", "GET", "GETS", "GOT", "SEEM", "SEEMS", "BECOME", "BECOMES"]
DETERMINERS = ["the", "a", "an", "this", "that", "these", "those"]
TRAILING_TYPES = ["satellite", "satellites", "sensor", "sensors", "mission", "missions", "payload", "payloads", "instrument", "instruments", "spacecraft", "series"]
LEXICON = {
    "insat3d": "INSAT-3D", "insat3dr": "INSAT-3DR", "insat3a": "INSAT-3A", "oceansat2": "Oceansat-2", "oceansat3": "Oceansat-3", "scatsat1": "SCATSAT-1", "meghatropiques": "Megha-Tropiques", "kalpana1": "Kalpana-1", "cartosat": "Cartosat",
    "resourcesat2": "Resourcesat-2", "saral": "SARAL", "altika": "AltiKa", "ocm": "OCM", "ocm2": "OCM-2", "ocm3": "OCM-3", "scatterometer": "Scatterometer", "msmr": "MSMR", "sar": "SAR", "isro": "ISRO", "sac": "Space Applications Centre",
    "sst": "Sea Surface Temperature", "ndvi": "NDVI", "chlorophyll": "Chlorophyll",
}

# Properties and units of measurements.
PROPERTIES = {
    "spatial_resolution": ["spatial resolution", "ground resolution", "pixel size", "ground sampling", "ifov", "spatial sampling", "resolution"],
    "temporal_resolution": ["temporal resolution", "revisit time", "revisit", "repeat cycle", "repeativity", "repetivity", "repeat period", "temporal sampling"],
    "swath_width": ["swath width", "swath", "ground swath"],
    "frequency": ["frequency", "operating frequency", "centre frequency", "center frequency"],
    "wavelength": ["wavelength", "spectral band", "central wavelength"],
    "altitude": ["altitude", "orbital height", "orbit height"],
    "inclination": ["inclination"],
    "spectral_channels": ["number of channels", "spectral channels", "channels", "number of bands", "bands"],
    "data_rate": ["data rate", "downlink rate", "bit rate"],
    "spatial_coverage": ["spatial coverage", "coverage"],
}
UNITS = {
    "km": ("m", 1000.0), "m": ("m", 1.0), "cm": ("m", 0.01), "mm": ("m", 0.001), "µm": ("m", 1e-6), "um": ("m", 1e-6), "micron": ("m", 1e-6), "nm": ("m", 1e-9), "ghz": ("Hz", 1e9), "mhz": ("Hz", 1e6), "khz": ("Hz", 1e3), "hz": ("Hz", 1.0),
    "day": ("s", 86400.0), "days": ("s", 86400.0), "d": ("s", 86400.0), "hour": ("s", 3600.0), "hours": ("s", 3600.0), "hr": ("s", 3600.0), "hrs": ("s", 3600.0), "h": ("s", 3600.0), "minute": ("s", 60.0), "minutes": ("s", 60.0),
    "min": ("s", 60.0), "second": ("s", 1.0), "seconds": ("s", 1.0), "sec": ("s", 1.0), "s": ("s", 1.0), "deg": ("deg", 1.0), "degree": ("deg", 1.0), "degrees": ("deg", 1.0), "°": ("deg", 1.0), "gbps": ("bps", 1e9), "mbps": ("bps", 1e6),
    "kbps": ("bps", 1e3), "bps": ("bps", 1.0),
}
NUMBER_UNIT = r"([0-9]+(?:\.[0-9]+)?(?:\s?[xX×]\s?10\^?-?[0-9]+)?)\s*(km|cm|mm|µm|um|micron|nm|m(?![a-z])|GHz|MHz|kHz|Hz|days?|hours?|hrs?|hr|minutes?|min|seconds?|sec|°|degrees?|deg|Gbps|Mbps|kbps|bps)?"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def sanitized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.trim(text)), r"[^A-Za-z0-9_]+", "_"), F.lit("_"))


def canonical_relation(verb: Column) -> Column:
    """Relation of a verb phrase: exact, then the longest phrase of several words inside it, then its own name; null for verbs without meaning."""
    raw = F.lower(F.trim(verb))
    phrases = [v for v in sorted(VERB_TO_RELATION, key=len, reverse=True) if " " in v]
    own = sanitized(raw)
    out = F.when(own.isin(RELATION_TYPES), own).when(own.isin(TRIVIAL) | (own == ""), F.lit(None)).otherwise(own)
    for phrase in reversed(phrases):
        out = F.when(raw.contains(phrase), VERB_TO_RELATION[phrase]).otherwise(out)
    exact = F.try_element_at(literal_map(VERB_TO_RELATION), raw)
    return F.when(F.coalesce(raw, F.lit("")) != "", F.coalesce(exact, out))


def node_type(raw: Column) -> Column:
    alias = F.try_element_at(literal_map(TYPE_ALIASES), F.lower(F.trim(raw)))
    title = F.replace(F.initcap(F.trim(raw)), F.lit(" "), F.lit(""))
    return F.coalesce(alias, F.when(title.isin(NODE_TYPES), title), F.lit("Concept"))


def _stripped(words: Column) -> Column:
    words = F.when(F.get(words, F.lit(0)).isin(DETERMINERS), F.slice(words, 2, 1000)).otherwise(words)
    return F.when((F.size(words) > 1) & F.try_element_at(words, F.lit(-1)).isin(TRAILING_TYPES), F.slice(words, 1, F.size(words) - 1)).otherwise(words)


def canonical_key(name: Column) -> Column:
    """Identity of a name: lower-cased, without punctuation, leading determiner, trailing type word, blanks and hyphens."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_\s-]", " "), r"\s+", " "))
    return F.replace(F.array_join(_stripped(F.split(low, " ", -1)), ""), F.lit("-"), F.lit(""))


def canonical_name(name: Column, lexicon: dict[str, str] = LEXICON) -> Column:
    """The name that a lexicon (key -> name; callers bring their own) has for a known key, else the name without determiner (as written in lower case) and trailing type word."""
    known = F.try_element_at(literal_map(lexicon), canonical_key(name))
    bare = F.trim(F.array_join(_stripped(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ", -1)), " "), F.lit(" -"))
    return F.coalesce(known, F.when(bare != "", bare), F.trim(name))


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_QUANTITY = re.compile(NUMBER_UNIT, re.IGNORECASE)


def quantities(text: str | None) -> list[tuple[str, float, str, str, float, str]]:
    """(property, value, unit, raw, base value, base unit) of each number that follows a property's keyword in its sentence."""
    found: dict[tuple[str, str], tuple] = {}
    for sentence in _SENTENCE.split(text or ""):
        low = sentence.lower()
        if not any(k in low for keys in PROPERTIES.values() for k in keys):
            continue
        for m in _QUANTITY.finditer(sentence):
            number = m[1].lower().replace("×", "x").replace(" ", "")
            mantissa, _, power = number.partition("x10")
            value = float(mantissa) * 10.0 ** int(power.lstrip("^") or 0)
            last, name = max(((low.rfind(k, 0, m.start()), -i, p) for i, (p, keys) in enumerate(PROPERTIES.items()) for k in keys), key=lambda x: x[:2])[0::2]
            if last < 0 or name == "spectral_channels" and m[2]:
                continue
            base, factor = UNITS.get((m[2] or "").lower(), ("", 1.0))
            raw = m[0].strip()
            found.setdefault((name, raw.lower()), (name, value, m[2] or "", raw, value * factor, base))
    return list(found.values())


def balanced_objects(text: str | None) -> list[str]:
    """Every balanced {...} of a text, inner ones too, in the order in which they close."""
    out, stack = [], []
    for i, ch in enumerate(text or ""):
        if ch == "{":
            stack.append(i)
        elif ch == "}" and stack:
            out.append(text[stack.pop() : i + 1])
    return out


def salvage_triples(text: str | None) -> list[str]:
    """JSON of the triples in a model's answer: of its first well-formed wrapper, else of all complete ones."""
    objects = []
    for piece in balanced_objects(text):
        try:
            objects.append(json.loads(piece))
        except ValueError:
            continue
    for o in objects:
        if isinstance(o, dict) and "triples" in o:
            return [json.dumps(t, sort_keys=True) for t in o["triples"]]
    return [json.dumps(o, sort_keys=True) for o in objects if isinstance(o, dict) and "subject" in o and "object" in o]
