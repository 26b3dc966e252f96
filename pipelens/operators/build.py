"""The network's tables from the statements of a graph export, by joins on the statements.

A statement is (s, p, o); see ``sources.graph.triples``. Where a thing has several values
of a kind the smallest counts, so that results do not depend on the order of statements.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens import config
from pipelens.model import Tables
from pipelens.operators import graph, hierarchy
from pipelens.sources import graph as statements
from pipelens.sources.graph import short_name

#: Classes of vertices by end, of geometries and of levels; fixed values of the vocabulary.
BEGIN = ("BeginpuntLeiding", "BeginpuntOnderdeel", "BeginpuntAfvoerrelatie")
END = ("EindpuntLeiding", "EindpuntOnderdeel", "EindpuntAfvoerrelatie")
POINT, LINE = "Punt", "Lijn"
#: Aspects of nodes and of conduits, by the column they fill; fixed values of the vocabulary.
NODE_SIZES = {"height_mm": "HoogtePut", "width_mm": "BreedtePut", "length_mm": "LengtePut"}
CONDUIT_SIZES = {"height_mm": "HoogteLeiding", "width_mm": "BreedteLeiding", "length_m": "LengteLeiding"}


class Statements:
    """Statements by predicate, read once. ``distinct`` says that none of them is given twice."""

    def __init__(self, triples: DataFrame, distinct: bool = False):
        rows = triples.select("s", short_name(F.col("p")).alias("p"), "o").where("s is not null and p is not null and o is not null")
        self.all = graph.written(rows if distinct else rows.distinct(), "p")

    @cached_property
    def described(self) -> DataFrame:
        """(owner, aspect, value, date, ref, kind): every aspect with its smallest value, date and reference, a row for each of its owners and classes; worked out once and stored by class."""
        told = self.all.where(F.col("p").isin("hasValue", "hasReference")).select(F.col("s").alias("aspect"), F.when(F.col("p") == "hasValue", F.col("o")).alias("value"), F.when(F.col("p") == "hasReference", short_name(F.col("o"))).alias("ref"))
        # Dealt by aspect first: hardly any has several values, so sums before the shuffle would save nothing.
        said = told.repartition("aspect").groupBy("aspect").agg(F.min("value").alias("value"), F.min(statements.date_of(F.col("value"))).alias("date"), F.min("ref").alias("ref"))
        kinds = self.of("type", "aspect", "uri").repartition("aspect").select("aspect", short_name(F.col("uri")).alias("kind")).distinct()
        return graph.written(self.of("hasAspect", "owner", "aspect").join(kinds, "aspect").join(said, "aspect", "left").select("owner", "aspect", "value", "date", "ref", "kind"), "kind")

    def held(self, owner: str, aspect: str, *classes: str) -> DataFrame:
        """(owner, aspect, value, date, ref) of the aspects of one of the classes."""
        rows = self.described.where(F.col("kind").isin(*classes)).select(F.col("owner").alias(owner), F.col("aspect").alias(aspect), "value", "date", "ref")
        return rows if len(classes) == 1 else rows.dropDuplicates([owner, aspect])

    def of(self, predicate: str, s: str, o: str) -> DataFrame:
        return self.all.where(F.col("p") == predicate).select(F.col("s").alias(s), F.col("o").alias(o))

    def typed(self, name: str, *classes: str) -> DataFrame:
        """(name): the things of one of the classes, by short name."""
        return self.of("type", name, "cls").where(short_name(F.col("cls")).isin(*classes)).select(name).distinct()

    def types(self, name: str, things: DataFrame) -> DataFrame:
        """(name, types): short names of the classes of each of ``things`` (name); most typed things are aspects, whose classes nobody asks for here."""
        asked = self.of("type", name, "cls").join(things.select(name).distinct(), name, "left_semi")
        return asked.groupBy(name).agg(F.array_sort(F.collect_set(short_name(F.col("cls")))).alias("types"))

    def labels(self, name: str) -> DataFrame:
        return self.of("label", name, "label").groupBy(name).agg(F.min("label").alias("label"))

    def connections(self, a: str, b: str) -> DataFrame:
        """Connections both ways round: the property is symmetric."""
        own = self.of("hasConnection", a, b)
        return own.unionByName(own.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()

    def aspects(self, owner: str, *classes: str) -> DataFrame:
        """(owner, aspect, value) of the aspects of one of the classes that have a value."""
        return self.held(owner, "aspect", *classes).select(owner, "aspect", "value").where("value is not null")


def _smallest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each key: the smallest of the columns, taken together."""
    return df.groupBy(key).agg(F.min(F.struct(*columns)).alias("m")).select(key, "m.*")


def provenance(st: Statements) -> DataFrame:
    """(aspect, method, date): how and when the value of an aspect was gathered; the first provenance node that says either."""
    nodes = st.held("aspect", "node", "Inwinning").select("aspect", "node")
    how = st.held("node", "part", "WijzeVanInwinning").groupBy("node").agg(F.min("ref").alias("method"))
    when = st.held("node", "part", "DatumInwinning").groupBy("node").agg(F.min("date").alias("date"))
    known = nodes.join(how, "node", "left").join(when, "node", "left").where("method is not null or date is not null")
    return _smallest(known, "aspect", "node", "method", "date").drop("node")


def with_provenance(st: Statements, found: DataFrame, holder: str) -> DataFrame:
    """Adds (method, date) to rows of (holder, aspect, ...): the aspect's own provenance, else that of the point beside it."""
    own = provenance(st)
    point = _smallest(st.aspects(holder, POINT).select(holder, "aspect").join(own, "aspect"), holder, "aspect", "method", "date")
    beside = point.select(holder, F.col("method").alias("point_method"), F.col("date").alias("point_date"))
    mine = own.withColumn("own", F.lit(True))
    joined = found.join(mine, "aspect", "left").join(beside, holder, "left")
    pick = lambda c: F.when(F.col("own"), F.col(c)).otherwise(F.col(f"point_{c}")).alias(c)
    return joined.select(*found.columns, pick("method"), pick("date"))


def ground_levels(st: Statements) -> DataFrame:
    """(orientation, value, method, date): the ground level of the ground orientation that an orientation is connected with."""
    grounds = st.connections("orientation", "ground").join(st.typed("ground", "Maaiveldorientatie"), "ground")
    found = grounds.join(st.aspects("ground", "Maaiveldhoogte"), "ground")
    first = _smallest(found, "orientation", "ground", "aspect", "value")
    return with_provenance(st, first, "ground").select("orientation", F.col("value").try_cast("double").alias("value"), "method", "date")


def cover_levels(st: Statements) -> DataFrame:
    """(object, value, method, date): the cover's level on the object, else by its cover's orientation, else on the cover."""
    level = "Putdekselniveau"
    covers = st.of("hasPart", "object", "cover").join(st.typed("cover", "Putdeksel"), "cover")
    ways = [
        st.aspects("object", level).withColumn("holder", F.col("object")),
        covers.join(st.of("hasAspect", "cover", "holder"), "cover").join(st.aspects("holder", level), "holder"),
        covers.withColumn("holder", F.col("cover")).join(st.aspects("holder", level), "holder"),
    ]
    rows = None
    for k, way in enumerate(ways):
        part = way.select("object", F.lit(k).alias("way"), "holder", "aspect", "value")
        rows = part if rows is None else rows.unionByName(part)
    first = _smallest(rows, "object", "way", "holder", "aspect", "value")
    return with_provenance(st, first, "holder").select("object", F.col("value").try_cast("double").alias("value"), "method", "date")


def geometries(st: Statements, kind: str) -> DataFrame:
    """(orientation, pts, zs, multipart, error) of the first geometry aspect; several of them make it multipart."""
    found = st.aspects("orientation", kind)
    first = found.groupBy("orientation").agg(F.count("*").alias("n"), F.min(F.struct("aspect", "value")).alias("m"))
    read = first.withColumn("g", statements.gml(F.col("m.value")))
    return read.select("orientation", F.when(F.col("g.error").isNull(), F.col("g.pts")).alias("pts"), F.when(F.col("g.error").isNull(), F.col("g.zs")).alias("zs"), ((F.col("n") > 1) | F.col("g.multipart")).alias("multipart"), "g.error")


def orientations(st: Statements, closure: DataFrame | None, root: str) -> DataFrame:
    """(orientation, object): by the class of the orientation where the class tree knows ``root``, else by its geometry or vertices."""
    if closure is not None:
        names = closure.where(F.col("root") == root).select(F.col("cls").alias("kind"))
        if not names.where(F.col("kind") != root).isEmpty():
            return st.described.join(F.broadcast(names), "kind").select(F.col("aspect").alias("orientation"), F.col("owner").alias("object")).distinct()
    return st.of("hasAspect", "object", "orientation").join(structural(st, root), "orientation")


def structural(st: Statements, root: str) -> DataFrame:
    """(orientation): those that have a point (nodes), or a begin or end vertex (conduits)."""
    if root == "Knooppunt":
        return st.held("orientation", "point", POINT).select("orientation").distinct()
    return st.of("hasPart", "orientation", "vertex").join(st.typed("vertex", *BEGIN, *END), "vertex").select("orientation").distinct()


def _sizes(st: Statements, owner: str, kinds: dict[str, str]) -> DataFrame:
    """A row per owner with a column for each kind of size."""
    rows = None
    for column, kind in kinds.items():
        part = st.aspects(owner, kind).select(owner, F.lit(column).alias("column"), F.col("value").try_cast("double").alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(owner).pivot("column", list(kinds)).agg(F.min("v"))


def _texts(st: Statements, owner: str, kind: str, name: str) -> DataFrame:
    """(owner, name): the reference, or else the value, of an aspect of a kind, as a short name."""
    return st.held(owner, "aspect", kind).groupBy(owner).agg(F.min(F.coalesce("ref", "value")).alias(name))


def _dates(st: Statements, owner: str) -> DataFrame:
    rows = None
    for column, kind in (("begin_date", "Begindatum"), ("end_date", "Einddatum")):
        part = st.aspects(owner, kind).select(owner, F.lit(column).alias("column"), statements.date_of(F.col("value")).alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(owner).pivot("column", ["begin_date", "end_date"]).agg(F.min("v"))


def node_table(st: Statements, closure: DataFrame | None = None) -> DataFrame:
    """A row for each node; an object with several orientations keeps the smallest."""
    own = graph.written(_smallest(orientations(st, closure, "Knooppunt"), "object", "orientation"))
    # Objects and orientations at once, so that the types of all things are shuffled once.
    types = graph.written(st.types("thing", own.select(F.col("object").alias("thing")).unionByName(own.select(F.col("orientation").alias("thing")))))
    typed = lambda key, name: types.select(F.col("thing").alias(key), F.col("types").alias(name))
    parent = st.of("hasPart", "parent", "object").where("parent <> object and not startswith(parent, '_:')").groupBy("object").agg(F.min("parent").alias("parent_id"))
    level = lambda df, key, name: df.select(key, F.col("value").alias(name), F.col("method").alias(f"{name}_method"), F.col("date").alias(f"{name}_date"))
    joined = (
        own.join(geometries(st, POINT), "orientation", "left").join(level(ground_levels(st), "orientation", "ground"), "orientation", "left").join(typed("orientation", "orientation_types"), "orientation", "left")
    )
    for more in (level(cover_levels(st), "object", "cover"), typed("object", "types"), st.labels("object"), parent, _sizes(st, "object", NODE_SIZES), _texts(st, "object", "MateriaalPut", "material"), _dates(st, "object")):
        joined = joined.join(more, "object", "left")
    point = F.get("pts", F.lit(0))
    return joined.select(
        F.col("object").alias("node_id"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("types", F.array().cast("array<string>")).alias("types"), "orientation", "orientation_types", "parent_id",
        point["x"].alias("x"), point["y"].alias("y"), F.get("zs", F.lit(0)).alias("z"), "ground", "ground_method", "ground_date", "cover", "cover_method", "cover_date",
        *NODE_SIZES, "material", "begin_date", "end_date", F.year("begin_date").alias("begin_year"), F.coalesce("multipart", F.lit(False)).alias("multipart"), "error",
    )


def endpoints(st: Statements, nodes: DataFrame) -> DataFrame:
    """(orientation, side, vertex, node_id, bob): the vertex of each end, the node whose orientation it is connected with, and its invert."""
    out = None
    at = nodes.select(F.col("orientation").alias("target"), "node_id")
    for side, classes, bob in (("start", BEGIN, "BobBeginpuntLeiding"), ("end", END, "BobEindpuntLeiding")):
        vertex = _smallest(st.of("hasPart", "orientation", "vertex").join(st.typed("vertex", *classes), "vertex"), "orientation", "vertex")
        known = _smallest(st.connections("vertex", "target").join(at, "target"), "vertex", "target", "node_id").drop("target")
        level = _smallest(st.aspects("vertex", bob), "vertex", "aspect", "value").select("vertex", F.col("value").try_cast("double").alias("bob"))
        part = vertex.join(known, "vertex", "left").join(level, "vertex", "left").select("orientation", F.lit(side).alias("side"), "vertex", "node_id", "bob")
        out = part if out is None else out.unionByName(part)
    return out


def conduit_table(st: Statements, nodes: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """A row for each conduit; an object with several orientations keeps the smallest."""
    own = graph.written(_smallest(orientations(st, closure, "Verbinding"), "object", "orientation"))
    ends = graph.cut(endpoints(st, nodes))
    side = lambda name: ends.where(F.col("side") == name).select("orientation", F.col("node_id").alias(f"{name}_id"), F.col("bob").alias(f"bob_{name}"))
    joined = own.join(geometries(st, LINE), "orientation", "left").join(side("start"), "orientation", "left").join(side("end"), "orientation", "left")
    for more in (
        st.types("object", own), st.labels("object"), _sizes(st, "object", CONDUIT_SIZES), _texts(st, "object", "MateriaalLeiding", "material"), _texts(st, "object", "VormLeiding", "shape"), _dates(st, "object"),
    ):
        joined = joined.join(more, "object", "left")
    return joined.select(
        F.col("object").alias("conduit_id"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("types", F.array().cast("array<string>")).alias("types"), "orientation", "start_id", "end_id", "pts", "zs",
        "bob_start", "bob_end", *CONDUIT_SIZES, "material", "shape", "begin_date", "end_date", F.year("begin_date").alias("begin_year"), F.coalesce("multipart", F.lit(False)).alias("multipart"), "error",
    )


def structural_difference(st: Statements, nodes: DataFrame, conduits: DataFrame) -> DataFrame:
    """(role, without_geometry, without_role): what the class tree and the structure each find alone."""
    out = None
    for role, table, key, root in (("node", nodes, "node_id", "Knooppunt"), ("conduit", conduits, "conduit_id", "Verbinding")):
        shape = st.of("hasAspect", "object", "orientation").join(structural(st, root), "orientation").select("object").distinct().withColumn("shaped", F.lit(1))
        named = table.select(F.col(key).alias("object")).distinct().withColumn("named", F.lit(1))
        part = named.join(shape, "object", "full").agg(F.count_if(F.col("shaped").isNull()).alias("without_geometry"), F.count_if(F.col("named").isNull()).alias("without_role")).select(F.lit(role).alias("role"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def subset(t: Tables, wanted: DataFrame) -> Tables:
    """The tables with only the nodes and conduits of ``wanted`` (object_id); parts and connections stay whole."""
    from dataclasses import replace

    ids = wanted.select("object_id").distinct()
    of = lambda df, key: df.join(ids.withColumnRenamed("object_id", key), key, "left_semi")
    return replace(t, node=of(t.node, "node_id"), conduit=of(t.conduit, "conduit_id"), memo={})


def tables(triples: DataFrame, ontology: DataFrame | None = None, cfg: config.Config | None = None) -> Tables:
    """The network of an export, ready for the rules. Parents that are no network nodes are followed up for conduit ends."""
    st = Statements(triples)
    classes = statements.class_edges(triples if ontology is None else ontology)
    closure = graph.cut(hierarchy.closure(classes))
    node = graph.written(node_table(st, closure))
    conduit = conduit_table(st, node, closure)
    t = Tables(
        node=node, conduit=conduit, class_edge=classes, cfg=cfg or config.Config(), part=statements.parts(triples), connection=statements.connections(triples), aspect=statements.aspects(triples),
    )
    roots = t.node.where(t.is_a(config.NODE, *config.OUTFLOW, *config.DISCHARGE, *config.TANK)).select(F.col("node_id").alias("id"))
    above = hierarchy.climb(node.select(F.col("node_id").alias("object_id")), node.where("parent_id is not null").select(F.col("node_id").alias("child_id"), "parent_id"), roots)
    found = above.groupBy("object_id").agg(F.min("node_id").alias("resolved"))
    for side in ("start", "end"):
        to = found.select(F.col("object_id").alias(f"{side}_id"), F.col("resolved").alias(f"{side}_resolved"))
        conduit = conduit.join(to, f"{side}_id", "left").withColumn(f"{side}_id", F.coalesce(f"{side}_resolved", f"{side}_id")).drop(f"{side}_resolved")
    t.conduit = graph.written(conduit)
    return t


def type_names(t: Tables) -> DataFrame:
    """(object_id, type_name): the first of an object's own types in alphabetical order, else of its orientation's."""
    rows = t.node.select(F.col("node_id").alias("object_id"), "types", F.col("orientation_types") if "orientation_types" in t.node.columns else F.array().cast("array<string>").alias("orientation_types"))
    rows = rows.unionByName(t.conduit.select(F.col("conduit_id").alias("object_id"), "types", F.array().cast("array<string>").alias("orientation_types")))
    return rows.select("object_id", F.coalesce(F.array_min("types"), F.array_min("orientation_types")).alias("type_name"))


def parent_chain(objects: DataFrame, parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(object_id, link_id): all objects on the way from an object up to the first of ``wanted`` (id), both ends included.

    Where each object has one parent, ways are arrays: those of objects that are parents double
    in a round, and the others, mostly the many, take their parent's at the end.
    """
    goal = wanted.select(F.col("id").alias("at")).where("at is not null").distinct()
    pairs = parents.where("child_id <> parent_id").groupBy(F.col("child_id").alias("at")).agg(F.min("parent_id").alias("above"), F.max("parent_id").alias("other"))
    pairs = graph.written(pairs.join(goal, "at", "left_anti"))
    if not pairs.where("above <> other").isEmpty():
        return _ways_of_several(objects, parents, wanted)
    ups = pairs.select("at", "above")
    ended = goal.select(F.col("at").alias("above"), F.lit(True).alias("ended"))
    first = ups.join(ups.select(F.col("above").alias("at")).distinct(), "at", "left_semi").join(ended, "above", "left")
    known = graph.written(first.select("at", F.array("above").alias("way"), F.coalesce("ended", F.lit(False)).alias("ended")))
    while True:
        going = known.where("not ended").withColumn("last", F.element_at("way", -1))
        # A way whose last object has none ends below no goal, one that meets an object twice goes round: neither is followed.
        step = going.join(known.select(F.col("at").alias("last"), F.col("way").alias("more"), F.col("ended").alias("done")), "last")
        step = step.select("at", F.concat("way", "more").alias("way"), F.col("done").alias("ended")).where(F.size(F.array_distinct("way")) == F.size("way"))
        if going.isEmpty():
            break
        known = graph.written(known.where("ended").unionByName(step))
    own = objects.select(F.col("object_id").alias("at")).distinct()
    top = goal.select(F.col("at").alias("above"), F.array().cast("array<string>").alias("way"))
    ways = known.select(F.col("at").alias("above"), "way").unionByName(top)
    found = ups.join(own, "at", "left_semi").join(ways, "above").select(F.col("at").alias("object_id"), F.explode(F.concat(F.array("at", "above"), "way")).alias("link_id"))
    return found.unionByName(own.join(goal, "at", "left_semi").select(F.col("at").alias("object_id"), F.col("at").alias("link_id")))


def _ways_of_several(objects: DataFrame, parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``parent_chain`` where objects have several parents: each way up is followed."""
    goal = wanted.select(F.col("id").alias("at")).distinct()
    ups = parents.where("child_id <> parent_id").select(F.col("child_id").alias("at"), F.col("parent_id").alias("above")).distinct().join(goal, "at", "left_anti")
    way = hierarchy.closure(ups.select(F.col("above").alias("parent"), F.col("at").alias("child"))).where("root <> cls")
    reach = hierarchy.climb(objects, parents, wanted)
    own = reach.select("object_id", F.col("object_id").alias("link_id")).unionByName(reach.select("object_id", F.col("node_id").alias("link_id")))
    # A link lies above the object and below the node that the object reaches.
    above = reach.join(way.select(F.col("cls").alias("object_id"), F.col("root").alias("link_id")), "object_id")
    below = way.select(F.col("root").alias("node_id"), F.col("cls").alias("link_id"))
    return own.unionByName(above.join(below, ["node_id", "link_id"], "left_semi").select("object_id", "link_id")).distinct()


def direction_labels(t: Tables) -> DataFrame:
    """(conduit_id, direction): whether a conduit falls with or against its drawn line, unknown without a fall or a drawn direction."""
    place = lambda p: t.node.select(F.col("node_id").alias(f"{p}_id"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    rows = t.conduit.join(place("start"), "start_id", "left").join(place("end"), "end_id", "left")
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    d = lambda p, q: F.sqrt((p["x"] - F.col(f"{q}x")) * (p["x"] - F.col(f"{q}x")) + (p["y"] - F.col(f"{q}y")) * (p["y"] - F.col(f"{q}y")))
    turned = d(first, "end") + d(last, "start") < d(first, "start") + d(last, "end")
    drawn = F.when((F.size("pts") >= 2) & (F.col("start_id") != F.col("end_id")), turned)
    fall = F.col("bob_start") - F.col("bob_end")
    label = F.when(fall.isNull() | (fall == 0) | drawn.isNull(), "unknown").when((fall > 0) != drawn, "with").otherwise("against")
    return rows.select("conduit_id", label.alias("direction"))


def date_precision(aspects: DataFrame) -> DataFrame:
    """(kind, n, new_year, share, years_only): per date aspect how many values fall on the first of January."""
    dated = aspects.where(F.lower("kind").contains("datum")).withColumn("date", statements.date_of(F.col("value"))).where("date is not null")
    found = dated.groupBy("kind").agg(F.count("*").alias("n"), F.count_if((F.month("date") == 1) & (F.dayofmonth("date") == 1)).alias("new_year"))
    return found.select("kind", "n", "new_year", (F.col("new_year") / F.col("n")).alias("share"), (F.col("new_year") == F.col("n")).alias("years_only"))


def provenance_fill(nodes: DataFrame, ends: DataFrame, unknown: tuple[str, ...] = ("Onbekend",)) -> DataFrame:
    """(series, n, with_method, unknown, methods): per level how many values say how they were gathered; ``ends`` is (side, bob, method)."""
    rows = nodes.where("ground is not null").select(F.lit("ground").alias("series"), F.col("ground_method").alias("method"))
    rows = rows.unionByName(nodes.where("cover is not null").select(F.lit("cover").alias("series"), F.col("cover_method").alias("method")))
    rows = rows.unionByName(ends.where("bob is not null").select(F.concat(F.lit("bob_"), "side").alias("series"), "method"))
    by_method = rows.groupBy("series", "method").agg(F.count("*").alias("n"))
    known = F.col("method").isNotNull()
    return by_method.groupBy("series").agg(
        F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("with_method"), F.sum(F.when(F.col("method").isin(*unknown), F.col("n")).otherwise(0)).alias("unknown"),
        F.array_join(F.array_sort(F.collect_list(F.when(known, F.concat_ws("=", "method", "n")))), ",").alias("methods"),
    )


def bob_provenance(st: Statements, nodes: DataFrame) -> DataFrame:
    """(side, bob, method) of the inverts at both ends."""
    kinds = {"start": "BobBeginpuntLeiding", "end": "BobEindpuntLeiding"}
    out = None
    for side, kind in kinds.items():
        part = st.aspects("vertex", kind).join(provenance(st), "aspect", "left").select(F.lit(side).alias("side"), F.col("value").try_cast("double").alias("bob"), "method")
        out = part if out is None else out.unionByName(part)
    return out
