"""Thresholds and classes that rules take as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Config:
    """Defaults of all thresholds, in metres, millimetres, shares and years. Fixed values of the rule catalog."""

    snap: float = 0.10
    duplicate_node: float = 0.30
    overlap_tolerance: float = 0.05
    overlap_length: float = 1.0
    zero_length: float = 0.01
    straightness: float = 0.50
    x_range: tuple[float, float] = (0.0, 300_000.0)
    y_range: tuple[float, float] = (300_000.0, 630_000.0)
    conflict_margin: float = 0.0
    parallel: int = 2
    attached: int = 4
    vertex_tolerance: float = 0.01
    spike_angle: float = 5.0
    near_line: float = 0.50
    small_size: float = 200.0
    centimetre_size: float = 100.0
    node_size_margin: float = 0.0
    first_year: int = 1870
    length_range: tuple[float, float] = (1.0, 200.0)
    length_share: float = 0.05
    raster_warning: float = 0.05
    raster_error: float = 0.25
    raster_depth: float = 3.0
    rise_warning: float = 0.01
    rise_error: float = 0.05
    slope_low: float = 0.001
    slope_high: float = 0.02
    drop: float = 0.25
    node_height: float = 6.0
    cover_range: tuple[float, float] = (0.5, 4.0)
    ground_fall: float = 1.0
    floor_above: float = 0.05
    floor_below: float = 0.50
    z_difference: float = 0.05
    water_distance: float = 25.0
    weir_depth: float = 0.40
    component_nodes: int = 25
    component_discharges: int = 2
    rounding_step: float = 0.05
    rounding_share: float = 0.80
    rounding_values: int = 30
    building: float = 1.0
    water: float = 1.0
    cover_distance: float = 2.0
    discharge_water: float = 10.0
    direction: str = "administrative"
    shell_buffer: float = 50.0
    systemic: float = 0.80
    rising_share: float = 0.10
    stacked: int = 3
    typing_minimum: float = 95.0
    label_pattern: str | None = None
    today: date = date(2026, 1, 1)
    critical: tuple[str, ...] = ("Overstortput", "Bergbezinkbassin", "Gemaal")
    trade_sizes: tuple[int, ...] = field(
        default=(63, 75, 80, 90, 100, 110, 125, 150, 160, 200, 250, 300, 315, 400, 500, 600, 700, 800, 900, 1000, 1100, 1200, 1250, 1400, 1500, 1600, 1800, 2000, 2500, 3000)
    )


#: Class roots of the network's vocabulary; fixed values. A root covers all its subclasses.
NODE = "Put"
GRAVITY = "VrijvervalRioolleiding"
CONDUIT = "Leiding"
MECHANICAL = ("Persleiding", "Drukleiding", "Vacuumleiding")
OUTFLOW = ("Gemaal", "Pompunit")
DISCHARGE = ("Lozingspunt", "UitlaatPunt", "Uitlaat", "Lozingsput", "Uitlaatconstructie")
FOUL = ("Vuilwaterriool", "GemengdRiool")
RAIN = ("Hemelwaterriool",)
INFILTRATION = ("Infiltratieriool",)
FUNCTIONLESS = ("LozePut", "BlindePut", "Ontstoppingsstuk", "Verbindingsstuk")
OVERFLOW_NODE = ("Overstortput", "Stuwput")
OVERFLOW_CONDUIT = ("Overstortleiding",)
TANK = ("Bergbezinkbassin", "Bergingsbassin", "Bezinkbassin")
DROP = ("Valput", "Zandvangput")
CROSSING = ("Zinker", "Duiker")
WATER = ("Oppervlaktewater",)

#: Roles of external layers.
ROLES = ("building", "water", "cover", "structure")

#: (child, parent) of the class tree that the rules are tested with.
CLASS_TREE = (
    [(c, NODE) for c in ("Inspectieput", *OVERFLOW_NODE, *DROP, *FUNCTIONLESS, *OUTFLOW, *DISCHARGE, *TANK, "Compartiment")]
    + [(c, GRAVITY) for c in (*FOUL, *RAIN, *INFILTRATION, *OVERFLOW_CONDUIT, "Drain", *CROSSING)]
    + [(c, "MechanischeLeiding") for c in MECHANICAL]
    + [(GRAVITY, CONDUIT), ("MechanischeLeiding", CONDUIT), ("Oppervlaktewater", "Waterobject")]
)

#: System type of a conduit by class root; fixed values.
SYSTEM_TYPES = {
    "mixed": "GemengdRiool", "foul": "Vuilwaterriool", "rain": "Hemelwaterriool", "infiltration": "Infiltratieriool",
    "drainage": "Drain", "overflow": "Overstortleiding", "transport": "Duiker",
}

#: Size range in mm by material; fixed values.
SIZES = [
    ("Beton", 200, 3000), ("GewapendBeton", 400, 3000), ("PVC", 100, 800), ("PE", 40, 1200), ("Polypropyleen", 100, 1200),
    ("Gres", 100, 1000), ("Metselwerk", 300, 4000), ("Asbestcement", 100, 1000), ("Gietijzer", 80, 1000), ("Staal", 80, 2000),
]
#: First and last year by material; fixed values.
YEARS = [("PVC", 1955, None), ("PE", 1970, None), ("Polypropyleen", 1975, None), ("GewapendBeton", 1920, None), ("Asbestcement", 1930, 1993), ("Metselwerk", None, 1960)]
#: Shapes by material; fixed values.
SHAPES = [
    ("Metselwerk", ["Eivormig", "Muilprofiel", "Heul", "Rechthoekig", "Ovaal"]), ("PVC", ["Rond"]), ("PE", ["Rond"]), ("Polypropyleen", ["Rond"]), ("Gres", ["Rond", "Eivormig"]),
]
#: What a shape asks of width and height; fixed values.
SHAPE_RULES = [("Rond", "equal"), ("Eivormig", "taller"), ("Muilprofiel", "wider"), ("Rechthoekig", "none"), ("Heul", "none")]
