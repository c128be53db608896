"""Pages to field signals.

pages: page_id, url, html.  One Python stage flattens the HTML; one shuffle on
page_id then serves the section as-of lookup, the grouping of radios and
checkboxes and the document order.
"""

from __future__ import annotations

from functools import partial

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.functions.text import clean_label, collapse, humanize_name
from formweave.functions.urls import ats_of_host, detect_ats, url_host
from formweave.operators.spread import spread
from formweave.rules.hosts import ATS_HOSTS
from formweave.sources import html_nodes
from formweave.sources.html_nodes import NODE_SCHEMA, node_rows

# the parser travels with the job, so executors need no installed package
cloudpickle.register_pickle_by_value(html_nodes)

JD_MIN, JD_MAX = 200, 6000
HEADING_MAX = LABEL_MAX = 120
GROUP_LABEL_MAX = 200
QUICK_FIELDS = r"(?i)<(?:input|select|textarea)\b|role\s*=\s*[\"']?combobox"


def with_form_controls(pages: DataFrame, at_least: int = 2) -> DataFrame:
    """Cheap gate before the parser: pages with a couple of form fields."""
    return pages.filter(F.regexp_count(F.col("html"), F.lit(QUICK_FIELDS)) >= at_least)


def page_nodes(pages: DataFrame, own_ui_attr: str | None = None) -> DataFrame:
    hosts = pages.select(F.col("page_id").cast("string").alias("page_id"), url_host(F.col("url")).alias("host"), "html")
    slim = hosts.select("page_id", ats_of_host(F.col("host")).alias("ats"), "html")
    return spread(slim, "page_id", "html").mapInArrow(partial(node_rows, own_ui_attr=own_ui_attr), NODE_SCHEMA)


def _attr(name: str) -> Column:
    return F.element_at("attrs", name)


def field_kind() -> Column:
    """Kind of a control; a combobox role on an input wins over its type."""
    tag, role = F.col("tag"), F.coalesce(_attr("role"), F.lit(""))
    kind = F.lower(F.coalesce(_attr("type"), F.lit("text")))
    editable = F.coalesce(_attr("contenteditable").isin("", "true"), F.lit(False))
    return (
        F.when(tag == "textarea", "textarea")
        .when(tag == "select", F.when(_attr("multiple").isNotNull(), "multiselect").otherwise("select"))
        .when(role == "combobox", "aria_combobox")
        .when((tag == "input") & kind.isin("email", "tel", "url", "number", "date", "checkbox", "file"), kind)
        .when((tag == "input") & (kind == "month"), "date")
        .when((tag == "input") & (kind == "radio"), "radio_group")
        .when(tag == "input", "text")
        .when(role == "listbox", "aria_listbox")
        .when(editable, "contenteditable")
    )


def label_and_source() -> Column:
    """struct(label, source): the first non-empty naming of the control."""
    given = lambda c: F.nullif(clean_label(c), F.lit(""))
    near = F.filter(
        F.transform("near", clean_label), lambda t: (F.length(t) >= 2) & (F.length(t) <= LABEL_MAX)
    )
    candidates = [
        (given(F.col("labels_text")), "label-for"),
        (given(F.col("for_text")), "label-for"),
        (given(F.col("labelledby_text")), "aria-labelledby"),
        (given(_attr("aria-label")), "aria-label"),
        (given(F.col("wrap_text")), "label-for"),
        (given(_attr("placeholder")), "placeholder"),
        (F.get(near, F.lit(0)), "geometric"),
        (F.nullif(humanize_name(_attr("name")), F.lit("")), "name-attr"),
    ]
    first = [F.when(c.isNotNull(), F.struct(c.alias("label"), F.lit(s).alias("source"))) for c, s in candidates]
    return F.coalesce(*first, F.struct(F.lit("").alias("label"), F.lit("none").alias("source")))


def is_required(label: Column) -> Column:
    raw = collapse(F.coalesce(F.col("labels_text"), F.col("for_text"), F.lit("")))
    return (
        _attr("required").isNotNull()
        | F.coalesce(_attr("aria-required") == "true", F.lit(False))
        | raw.rlike(r"[*✱]|(?i)\(required\)")
        | label.rlike(r"[*✱]$")
    )


def is_visible(inline_styles: bool) -> Column:
    """By attributes; optionally also by inline styles of the control and five ancestors.

    A file input hidden by its own style stays visible: it sits behind a drop zone.
    """
    shown = _attr("hidden").isNull() & ~F.coalesce(_attr("aria-hidden") == "true", F.lit(False))
    if not inline_styles:
        return shown
    file_itself = (F.col("style_hidden_at") == 0) & (F.col("kind") == "file")
    return shown & (F.col("style_hidden_at").isNull() | F.coalesce(file_itself, F.lit(False)))


def widget_hint() -> Column:
    cls, el_id = F.coalesce(_attr("class"), F.lit("")), F.coalesce(_attr("id"), F.lit(""))
    return (
        F.when(~F.col("kind").isin("aria_combobox", "aria_listbox"), "native")
        .when(cls.rlike(r"(?i)react-select|select__input") | el_id.rlike(r"^react-select"), "react_select")
        .when(F.col("ats") == "ashby", "ashby_combobox")
        .when(F.col("ats") == "greenhouse", "greenhouse_select")
        .when(F.col("ats") == "lever", "lever_native")
        .otherwise("unknown")
    )


def form_signals(nodes: DataFrame, frame_path: str = "top", inline_styles: bool = False) -> DataFrame:
    """One row per logical field, in document order."""
    in_page = Window.partitionBy("page_id").orderBy("pos")
    heading = F.nullif(
        F.substring(F.when(F.col("node") == "heading", collapse(F.col("text"))), 1, HEADING_MAX), F.lit("")
    )
    page_title = F.when(F.col("node") == "title", F.col("text"))
    controls = (
        nodes.filter("node IN ('heading', 'title', 'control')")
        .withColumn("section_heading", F.last(heading, ignorenulls=True).over(in_page))
        .withColumn("title", F.first(page_title, ignorenulls=True).over(in_page))
        .filter("node = 'control'")
        .withColumn("kind", field_kind())
        .withColumn("_label", label_and_source())
    )
    box = F.col("kind").isin("radio_group", "checkbox") & (F.coalesce(_attr("name"), F.lit("")) != "")
    between = F.when(F.col("kind") == "checkbox", F.lit("::cb::")).otherwise(F.lit("::"))
    value = F.coalesce(_attr("value"), F.lit("on"))
    text = F.coalesce(F.nullif(F.col("_label.label"), F.lit("")), value)
    checked = _attr("checked").isNotNull()
    length = F.try_to_number(_attr("maxlength"), F.lit("999999999")).cast("int")
    rows = controls.select(
        "page_id", "ats", "pos", "title", "section_heading", "kind", "selector", "selector_keys", "container_text",
        "legend", "options",
        F.when(box, F.concat(F.col("form_key"), between, _attr("name"))).alias("group_id"),
        F.when(box, F.concat(F.col("form_key"), between, _attr("name")))
        .otherwise(F.concat(F.lit("#"), F.col("pos"))).alias("_group"),
        F.col("_label.label").alias("label"), F.col("_label.source").alias("label_source"),
        _attr("placeholder").alias("placeholder"), _attr("name").alias("name_attr"), _attr("id").alias("id_attr"),
        _attr("autocomplete").alias("autocomplete"),
        is_required(F.col("_label.label")).alias("required"),
        is_visible(inline_styles).alias("visible"),
        widget_hint().alias("widget_hint"),
        F.when(F.col("kind") == "file", _attr("accept")).alias("accept"),
        F.when((length > 0) & F.col("tag").isin("input", "textarea"), length).alias("max_length"),
        F.array_append(F.map_entries("attrs"), F.struct(F.lit("").alias("key"), F.col("tag").alias("value"))).alias("_attrs"),
        value.alias("_value"), checked.alias("_checked"),
        F.struct(
            F.when(value != "on", value).otherwise(text).alias("value"), text.alias("text")
        ).alias("_option"),
        F.when(F.col("kind") == "checkbox", checked.cast("string"))
        .when(F.col("kind") != "file", F.nullif(F.col("current"), F.lit(""))).alias("current_value"),
    )
    # partitioned by page already, so neither the grouping nor the numbering shuffles again
    members = F.array_sort(F.collect_list(F.struct("pos", "selector", "selector_keys", "_attrs", "_option", "_value", "_checked")))
    first = F.min(F.struct("pos", F.struct(*[c for c in rows.columns if c not in ("page_id", "_group", "pos", "_attrs")]).alias("f")))
    grouped = rows.groupBy("page_id", "_group").agg(
        first.alias("first"), members.alias("members"), F.count("*").alias("n"),
        F.bool_or("required").alias("any_required"), F.bool_or("visible").alias("any_visible"),
    )
    f = lambda name: F.col(f"first.f.{name}")
    as_group = (f("kind") == "radio_group") & f("group_id").isNotNull() | ((f("kind") == "checkbox") & (F.col("n") > 1))
    legend_text = F.nullif(collapse(F.coalesce(f("legend"), F.lit(""))), F.lit(""))
    container = F.nullif(F.substring(F.coalesce(f("container_text"), F.lit("")), 1, GROUP_LABEL_MAX), F.lit(""))
    group_label = F.coalesce(
        legend_text, container, f("label")
    )
    picked = F.transform(F.filter("members", lambda m: m["_checked"]), lambda m: m["_value"])
    many = f("kind") == "checkbox"
    group_value = F.when(many, F.nullif(F.array_join(picked, ","), F.lit(""))).otherwise(F.get(picked, F.lit(0)))
    own = lambda name: F.when(~as_group, f(name)).alias(name)
    label = F.when(as_group, group_label).otherwise(f("label"))
    signals = grouped.select(
        "page_id", f("ats").alias("ats"), f("title").alias("title"),
        F.col("first.pos").alias("pos"), F.lit(frame_path).alias("frame_path"), f("selector").alias("selector"),
        F.when(as_group, F.transform("members", lambda m: m["selector"])).alias("member_selectors"),
        F.flatten(F.transform("members", lambda m: m["selector_keys"])).alias("selector_keys"),
        F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["_attrs"].alias("attrs"))).alias("elements"),
        F.when(as_group & many, "multiselect").otherwise(f("kind")).alias("kind"),
        label.alias("label"),
        F.when(as_group, F.when(f("legend").isNotNull(), "label-for").otherwise("geometric"))
        .otherwise(f("label_source")).alias("label_source"),
        own("placeholder"), f("name_attr").alias("name_attr"), f("id_attr").alias("id_attr"), own("autocomplete"),
        F.when(as_group, F.col("any_required") | label.rlike(r"[*✱]$")).otherwise(f("required")).alias("required"),
        F.when(as_group, F.transform("members", lambda m: m["_option"])).otherwise(f("options")).alias("options"),
        F.when(as_group, group_value).otherwise(f("current_value")).alias("current_value"),
        f("section_heading").alias("section_heading"),
        F.when(as_group, F.col("any_visible")).otherwise(f("visible")).alias("visible"),
        F.lit(False).alias("in_shadow"),
        F.when(as_group, f("group_id")).alias("group_id"),
        F.when(as_group, "native").otherwise(f("widget_hint")).alias("widget_hint"),
        own("accept"), own("max_length"),
    )
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return signals.withColumn("ref", F.concat(F.lit(f"{frame_path}:f"), number))


def job_descriptions(nodes: DataFrame) -> DataFrame:
    """The longest text block without controls per page, first one on a tie; short ones are no description."""
    text = collapse(F.col("text"))
    blocks = nodes.filter("node = 'block'").select("page_id", "pos", text.alias("t")).filter(F.length("t") >= JD_MIN)
    best = blocks.groupBy("page_id").agg(F.max_by("t", F.struct(F.length("t"), -F.col("pos"))).alias("t"))
    return best.select("page_id", F.substring("t", 1, JD_MAX).alias("jd_text"))


def embedded_boards(nodes: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Frames that embed a known job board: page_id, src, ats."""
    board = detect_ats(F.col("text"), rules or ATS_HOSTS)
    return (
        nodes.filter("node = 'iframe'").select("page_id", F.col("text").alias("src"), board.alias("ats"))
        .filter("ats <> 'generic'")
    )


def merge_frames(scans: DataFrame) -> DataFrame:
    """All signals of the latest scan of each frame; scans carry page_id, frame_path and scan_us."""
    last = F.max("scan_us").over(Window.partitionBy("page_id", "frame_path"))
    return scans.withColumn("_last", last).filter("scan_us = _last").drop("_last")
