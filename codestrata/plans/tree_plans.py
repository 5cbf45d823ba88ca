"""Tree and graph queries."""

from codestrata.operators import tree
from codestrata.plans.corpora import duck, load
from codestrata.session import scratch_path
from codestrata.sources.sinks import write_graph


def _nodes(spark, sf):
    return tree.tree_nodes(load(spark, sf, "inv"))


def _graph_sink(spark, sf):
    """Write the DOT lines, read the files back."""
    location = scratch_path(spark, "graph")
    write_graph(tree.to_dot(tree.tree_edges(_nodes(spark, sf))), location)
    written = spark.read.text(location)
    return written.selectExpr("repo", "value as text")


QUERIES = {
    "tree_nodes": _nodes,
    "dir_counts": lambda s, d: tree.dir_counts(load(s, d, "inv")),
    "tree_counts": lambda s, d: tree.tree_counts(_nodes(s, d)),
    "tree_text": lambda s, d: tree.tree_text(_nodes(s, d)),
    "tree_edges": lambda s, d: tree.tree_edges(_nodes(s, d)),
    "tree_dot": lambda s, d: tree.to_dot(tree.tree_edges(_nodes(s, d))),
    "tree_json": lambda s, d: tree.tree_json(_nodes(s, d)),
    "graph_sink": _graph_sink,
}

# --- oracle --------------------------------------------------------------------

_PARTS = f"select repo, path, string_split(path, '/') as p from ({duck('inv')})"
_NODES = f"""
exploded as (select repo, p, unnest(generate_series(0, len(p))) as depth from ({_PARTS})),
nodes as (select distinct repo, array_to_string(p[1:depth], '/') as node_path,
  case when depth = 0 then null else array_to_string(p[1:depth - 1], '/') end as parent,
  case when depth = 0 then '' else p[depth] end as name,
  case when depth = len(p) then 'file' else 'dir' end as kind, depth::bigint as depth from exploded),
keyed as (select *, case when depth = 0 then [] else list_transform(generate_series(1, depth), lambda i:
  {{'d': case when i = depth and kind = 'file' then 0 else 1 end, 'n': string_split(node_path, '/')[i]}}) end as walk,
  (kind = 'dir')::int as is_dir from nodes),
ordered as (select *, row_number() over (partition by repo order by walk) as line_no,
  row_number() over (partition by repo, parent order by is_dir desc, name desc) = 1 as is_last from keyed)"""
_IDS = f"""{_NODES},
edges as (select c.repo, c.line_no - 1 as id, case when c.depth = 0 then c.repo else c.name end as label, c.kind,
  p.line_no - 1 as parent_id from ordered c left join ordered p on c.repo = p.repo and c.parent = p.node_path and p.kind = 'dir')"""
_INDENT = (
    "select c.repo, c.node_path, string_agg(case when d.is_last then '    ' else '│   ' end, '' order by d.depth) as pieces "
    "from ordered c join ordered d on c.repo = d.repo and d.kind = 'dir' and d.depth > 0 and starts_with(c.node_path, d.node_path || '/') group by 1, 2"
)
_DOT = (
    "select repo, 0::bigint as line_no, 'digraph G {' as text from edges where id = 0 union all "
    "select repo, id * 2 + 1, '  ' || kind || '_' || id || ' [label=\"' || label || case when kind = 'dir' then '/' else '' end || '\", shape=' || "
    "case when kind = 'dir' then 'folder' else 'note' end || '];' from edges union all "
    "select repo, id * 2 + 2, '  dir_' || parent_id || ' -> ' || kind || '_' || id || ';' from edges where parent_id is not null union all "
    "select repo, max(id) * 2 + 3, '}' from edges group by repo"
)

ORACLES = {
    "tree_nodes": f"with {_NODES} select repo, node_path, parent, name, kind, depth from nodes",
    "dir_counts": f"select repo, array_to_string(p[1:n], '/') as dir, count(*)::bigint as file_count from "
    f"(select repo, p, unnest(generate_series(0, len(p) - 1)) as n from ({_PARTS})) group by 1, 2",
    "tree_counts": f"with {_NODES} select repo, count(*) - 1 as edge_count, count_if(kind = 'file')::bigint as file_count from nodes group by repo",
    "tree_text": f"with {_NODES} select o.repo, line_no, case when depth > 0 then '    ' else '' end || coalesce(pieces, '') || "
    "case when is_last then '└── ' else '├── ' end || case when depth = 0 then o.repo else name end || case when kind = 'dir' then '/' else '' end as text "
    f"from ordered o left join ({_INDENT}) i on o.repo = i.repo and o.node_path = i.node_path",
    "tree_edges": f"with {_IDS} select * from edges",
    "tree_dot": f"with {_IDS} {_DOT}",
    "graph_sink": f"with {_IDS} select repo, text from ({_DOT})",
}
