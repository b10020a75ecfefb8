"""Loading, checking and composing catalogs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from ..model import Catalog
from ..refusal import Refusal
from .consistency import consistent


def digest(catalog: Catalog) -> str:
    """SHA-256 of the definitions in canonical form: neither order nor layout of the documents moves it."""
    return hashlib.sha256(json.dumps(asdict(catalog), sort_keys=True, default=str).encode()).hexdigest()


def compose(*catalogs: Catalog) -> Catalog:
    """One catalog of several, whose whole is consistent; a name that two give to a model, relationship or metric is refused."""
    out: dict[str, dict] = {"models": {}, "relationships": {}, "metrics": {}}
    notes: tuple = ()
    for c in catalogs:
        for kind, have in out.items():
            own = getattr(c, kind)
            both = {x.lower() for x in have} & {x.lower() for x in own}
            if both:
                raise Refusal("name_collision", f"{kind}: {sorted(both)}")
            have.update(own)
        notes += c.notes
    return consistent(Catalog(out["models"], out["relationships"], out["metrics"], notes))
