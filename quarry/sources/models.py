"""Models as PMML text, written and read back."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

from ..config import InboundSettings
from ..operators.forest import Forest, Node

_WORD = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)')


def array_text(values: list[str]) -> str:
    """Values of an Array: quoted where they are empty or have spaces or quotes."""
    quoted = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return " ".join(quoted(v) if not v or re.search(r'[\s"\\]', v) else v for v in values)


def array_values(text: str | None) -> list[str]:
    return [m[2] if m[2] is not None else re.sub(r"\\(.)", r"\1", m[1]) for m in _WORD.finditer(text or "")]


def _document(*parts: ET.Element) -> str:
    root = ET.Element("PMML", version="4.1")
    root.extend(parts)
    return ET.tostring(root, encoding="unicode")


def _child(parent: ET.Element, tag: str, text: str | None = None, **attributes: str) -> ET.Element:
    out = ET.SubElement(parent, tag, attributes)
    out.text = text
    return out


def dictionary(settings: InboundSettings, levels: dict[str, list[str]] | None = None) -> ET.Element:
    """The data dictionary: every column's type, and the levels of categories."""
    out = ET.Element("DataDictionary", numberOfFields=str(len(settings.columns)))
    for c in settings.columns:
        numeric = c in settings.roles["numeric"]
        kind = {"optype": "continuous", "dataType": "double"} if numeric else {"optype": "categorical", "dataType": "string"}
        field = _child(out, "DataField", name=c, **kind)
        for v in (levels or {}).get(c, ()):
            _child(field, "Value", value=v)
    return out


def mining_schema(settings: InboundSettings) -> ET.Element:
    """How a model uses each column: active, predicted or supplementary."""
    out = ET.Element("MiningSchema")
    for c in settings.columns:
        use = "predicted" if c == settings.roles["target"] else "supplementary" if c in settings.roles["ignored"] else "active"
        _child(out, "MiningField", name=c, usageType=use)
    return out


def read_dictionary(text: str) -> dict[str, tuple[str, list[str]]]:
    """Column to (optype, levels)."""
    return {f.get("name"): (f.get("optype"), [v.get("value") for v in f.iter("Value")]) for f in ET.fromstring(text).iter("DataField")}


def clusters_to_pmml(fields: list[str], centers: list[list[float]], sizes: list[int] | None = None, settings: InboundSettings | None = None) -> str:
    model = ET.Element("ClusteringModel", modelClass="centerBased", numberOfClusters=str(len(centers)))
    for f in fields:
        _child(model, "ClusteringField", field=f)
    for i, c in enumerate(centers):
        own = _child(model, "Cluster", id=str(i), **({"size": str(sizes[i])} if sizes else {}))
        _child(own, "Array", " ".join(repr(float(x)) for x in c), n=str(len(c)), type="real")
    return _document(*([dictionary(settings), model] if settings else [model]))


def clusters_from_pmml(text: str) -> list[tuple[list[str], list[list[float]]]]:
    """(fields, centers) of every clustering model of a document."""
    out = []
    for model in ET.fromstring(text).iter("ClusteringModel"):
        rows = sorted(model.iter("Cluster"), key=lambda c: int(c.get("id")))
        out.append(([f.get("field") for f in model.iter("ClusteringField")], [[float(x) for x in c.find("Array").text.split()] for c in rows]))
    return out


def forest_to_pmml(forest: Forest) -> str:
    """Trees as nested nodes with predicates; weights on the segments."""
    kind = "classification" if forest.classes else "regression"

    def node(parent: ET.Element, nodes: dict[str, Node], path: str, above: Node | None) -> None:
        n = nodes[path]
        own = _child(parent, "Node", id=path, recordCount=repr(float(sum(n.counts) if forest.classes else (n.counts or [0])[0])))
        if above is None or path.endswith("-"):
            _child(own, "True")
        elif above.threshold is not None:
            _child(own, "SimplePredicate", field=above.feature, operator="greaterOrEqual", value=repr(above.threshold))
        else:
            test = _child(own, "SimpleSetPredicate", field=above.feature, booleanOperator="isIn")
            _child(test, "Array", array_text(above.categories), n=str(len(above.categories)), type="string")
        if n.feature is None:
            if forest.classes:
                for c, count in zip(forest.classes, n.counts):
                    _child(own, "ScoreDistribution", value=c, recordCount=repr(float(count)))
            else:
                _child(own, "Extension", name="sums", value=" ".join(repr(float(c)) for c in n.counts))
        else:
            own.set("defaultChild", path + ("+" if n.default else "-"))
            _child(own, "Extension", name="gain", value=repr(float(n.gain)))
            for side in "+-":
                node(own, nodes, path + side, n)

    model = ET.Element("MiningModel", functionName=kind)
    schema = _child(model, "MiningSchema")
    _child(schema, "MiningField", name=forest.target, usageType="predicted")
    parts = _child(model, "Segmentation", multipleModelMethod="weightedMajorityVote" if forest.classes else "weightedAverage")
    for t, (nodes, weight) in enumerate(zip(forest.trees, forest.weights)):
        segment = _child(parts, "Segment", id=str(t), weight=repr(float(weight)))
        _child(segment, "True")
        node(_child(segment, "TreeModel", functionName=kind, missingValueStrategy="defaultChild"), nodes, "r", None)
    return _document(model)


def forest_from_pmml(text: str) -> Forest:
    model = next(ET.fromstring(text).iter("MiningModel"))
    target = next(f.get("name") for f in model.iter("MiningField") if f.get("usageType") == "predicted")
    classes = None
    if model.get("functionName") == "classification":
        classes = list(dict.fromkeys(d.get("value") for d in model.iter("ScoreDistribution")))
    trees, weights = [], []
    for segment in model.iter("Segment"):
        nodes: dict[str, Node] = {}
        pending = [segment.find("TreeModel").find("Node")]
        while pending:
            at = pending.pop()
            n = nodes[at.get("id")] = Node(at.get("id"))
            own = {e.get("name"): e.get("value") for e in at.findall("Extension")}
            below = at.findall("Node")
            if below:
                n.default, n.gain = at.get("defaultChild").endswith("+"), float(own["gain"])
                yes = next(b for b in below if b.get("id").endswith("+"))
                test, among = yes.find("SimplePredicate"), yes.find("SimpleSetPredicate")
                n.feature = (test if test is not None else among).get("field")
                n.threshold = float(test.get("value")) if test is not None else None
                n.categories = None if among is None else array_values(among.find("Array").text)
            elif classes:
                held = {d.get("value"): float(d.get("recordCount")) for d in at.findall("ScoreDistribution")}
                n.counts = [held.get(c, 0.0) for c in classes]
            else:
                n.counts = [float(x) for x in own["sums"].split()]
            pending += below
        for n in sorted(nodes.values(), key=lambda n: -len(n.path)):  # counts of inner nodes from their sides
            if n.feature is not None:
                n.counts = [x + y for x, y in zip(nodes[n.path + "+"].counts, nodes[n.path + "-"].counts)]
        trees.append(nodes)
        weights.append(float(segment.get("weight")))
    return Forest(trees, weights, target, classes)


#: Tables of a factor model, by the name their description gives them.
ALS_TABLES = ("x", "y", "r", "names")


def factors_to_pmml(paths: dict[str, str]) -> str:
    """A description of where a factor model's tables are."""
    out = ET.Element("Extension", name="factors")
    for name, path in sorted(paths.items()):
        if name not in ALS_TABLES:
            raise ValueError(f"no such table: {name}")
        _child(out, "Extension", name=name, value=path)
    return _document(out)


def factors_from_pmml(text: str) -> dict[str, str]:
    return {e.get("name"): e.get("value") for e in ET.fromstring(text).find("Extension").findall("Extension")}
