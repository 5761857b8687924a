"""DuckDB oracle SQL for the office-package queries."""

F3 = """
m as (select 'pkg_' || cast(page_id // 8 as varchar) || '.pptx' path, cast(page_id as integer) member_ix,
  case page_id % 5 when 0 then 'ppt/slides/slide' || cast(page_id as varchar) || '.xml'
    when 1 then 'ppt/charts/chart' || cast(page_id as varchar) || '.xml'
    when 2 then 'ppt/slides/_rels/slide' || cast(page_id as varchar) || '.xml.rels'
    when 3 then 'ppt/media/m' || cast(page_id as varchar) || '.bin' else 'docProps/app.xml' end member,
  case when page_id % 5 = 0 and page_id % 3 = 0 then '<p:sld><p:oleObj id="' || cast(page_id as varchar) || '">x</p:oleObj><a:t>' || url || '</a:t></p:sld>'
    when page_id % 5 = 0 then '<p:sld><a:t>' || url || '</a:t></p:sld>'
    when page_id % 5 = 1 and page_id % 2 = 0 then '<c:chart><c:externalData r:id="r1"><c:autoUpdate val="0"/></c:externalData></c:chart>'
    when page_id % 5 = 1 then '<c:chart/>'
    when page_id % 5 = 2 and page_id % 4 <> 3 then '<Relationships><Relationship Id="r1" Target="' ||
      case when page_id % 4 = 0 then 'file:///x' else url end || '" TargetMode="External"/></Relationships>'
    when page_id % 5 = 2 then '<Relationships/>' else url end content from pages),
fd as (select path, member_ix, member, 1 kind, 'OLE in ' || member finding, false network from m
    where starts_with(member, 'ppt/slides/slide') and ends_with(member, '.xml') and (contains(content, '<p:oleObj') or contains(content, 'oleObject'))
  union all select path, member_ix, member, 2, 'External data in ' || member, false from m
    where starts_with(member, 'ppt/charts/') and ends_with(member, '.xml') and contains(content, '<c:externalData')
  union all select path, member_ix, member, 3, case when contains(content, 'Target="http://') or contains(content, 'Target="https://')
    then 'Network link in ' || member else 'File link in ' || member end,
    contains(content, 'Target="http://') or contains(content, 'Target="https://') from m
    where ends_with(member, '.rels') and contains(content, 'TargetMode="External"')
    and (contains(content, 'Target="http://') or contains(content, 'Target="https://') or contains(content, 'Target="file://'))),
agg as (select p.path, p.size_bytes, count(fd.kind) n_links, count(*) filter (where kind = 1) n_ole,
  count(*) filter (where kind = 2) n_chart, count(*) filter (where kind = 3) n_rel, count(*) filter (where network) n_net,
  string_agg(finding, '|' order by kind, fd.member_ix) links
  from (select path, sum(strlen(content)) size_bytes from m group by path) p left join fd on p.path = fd.path group by p.path, p.size_bytes),
sc as (select *, case when n_links = 0 then 0 when n_ole > 0 then 3 when n_chart > 0 and n_links > 3 then 3 when n_chart > 0 then 2
  when n_net > 0 then 2 else 1 end risk_level from agg),
sc2 as (select *, case risk_level when 0 then 'SAFE' when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' else 'CRITICAL' end risk_name from sc),
sz as (select *, case when ends_with(member, '.xml') and starts_with(member, 'ppt/slides/') and contains(content, '<p:oleObj') then true else false end ole,
  case when ends_with(member, '.xml') and starts_with(member, 'ppt/charts/') and contains(content, '<c:externalData') then true else false end chart from m),
sz2 as (select *, case when chart then regexp_replace(regexp_replace(case when ole then regexp_replace(content, '(?s)<p:oleObj\\b[^>]*/>|<p:oleObj\\b.*?</p:oleObj>', '', 'g') else content end,
  '(?s)<c:externalData.*?</c:externalData>', '', 'g'), '(?s)<c:autoUpdate.*?/>', '', 'g')
  when ole then regexp_replace(content, '(?s)<p:oleObj\\b[^>]*/>|<p:oleObj\\b.*?</p:oleObj>', '', 'g') else content end sanitized,
  concat_ws('|', case when ole then 'Removed OLE from ' || member end, case when chart then 'Broke chart links in ' || member end) ops from sz)
"""


def _w(body):
    return "with " + F3 + body


def _kind(k):
    return _w(f"select path, member, finding from fd where kind = {k}")


ORACLE = {
    "ole_slides": _kind(1),
    "chart_links": _kind(2),
    "external_rels": _kind(3),
    "utf8_decodable": _w("select path, member, length(content) % 3 <> 0 decodable from m"),
    "link_sources_union": _w("select path, kind, member, finding from fd"),
    "pkg_link_scan": _w("""select path, cast(n_links as integer) links_found, coalesce(links, '') external_links,
  concat_ws('|', case when n_ole > 0 then 'ole' end, case when n_chart > 0 then 'chart' end, case when n_rel > 0 then 'external_rel' end) link_types,
  true is_sanitizable, round(size_bytes / 1048576.0, 6) file_size_mb from sc2"""),
    "pkg_risk": _w("select path, cast(risk_level as integer) risk_level, risk_name from sc2"),
    "gate_decision": _w("""select path, case when risk_level >= 2 then 'sanitize' else 'proceed' end action,
  case when risk_level >= 2 then 'sanitize ' || risk_name || ' risk file' else '' end message from sc2"""),
    "strip_ole": _w("""select path, member, regexp_replace(content, '(?s)<p:oleObj\\b[^>]*/>|<p:oleObj\\b.*?</p:oleObj>', '', 'g') content_after from m
  where starts_with(member, 'ppt/slides/') and contains(content, '<p:oleObj')"""),
    "strip_chart_links": _w("""select path, member, regexp_replace(regexp_replace(content, '(?s)<c:externalData.*?</c:externalData>', '', 'g'),
  '(?s)<c:autoUpdate.*?/>', '', 'g') content_after from m where starts_with(member, 'ppt/charts/') and contains(content, '<c:externalData')"""),
    "strip_external_rels": _w("""select path, member, regexp_replace(content, '<Relationship\\b[^>]*TargetMode="External"[^>]*/>', '', 'g')
  content_after from m where ends_with(member, '.rels') and contains(content, 'TargetMode="External"')"""),
    "sanitize_members": _w("""select path, member, sanitized <> content changed, ops operations,
  cast(strlen(sanitized) as integer) bytes_after from sz2"""),
    "sanitize_ops": _w("""select path, coalesce(string_agg(ops, '|' order by member_ix) filter (where ops <> ''), '') operations,
  cast(sum(strlen(content)) as bigint) bytes_before, cast(sum(strlen(sanitized)) as bigint) bytes_after from sz2 group by path"""),
    "pkg_rewrite_join": _w("""select path, member, case when length(content) % 3 = 0 then hex(encode(content)) || 'C3'
  else hex(encode(sanitized)) end content_out from sz2"""),
    "pkg_members": _w("""select path, cast(member_ix % 8 as integer) member_ix, member, cast(0 as integer) part,
  case when length(content) % 3 <> 0 then content end content, hex(encode(content)) || case when length(content) % 3 = 0 then 'C3' else '' end raw,
  length(content) % 3 <> 0 readable from m"""),
    "office_discover": _w("select distinct path, true has_bytes from m"),
    "doc_discover": _w("select distinct path, true has_bytes from m"),
}
