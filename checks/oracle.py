"""The same results as plain SQL over the given tables.

Feed, API and listing results are stated from the articles and pages the payloads
were built from, so they check the parsing and not just repeat it.
"""

import re

from checks.views import ARTICLES, CATEGORIES, PAGES_META
from newsweave.sources.dims import source_rows

FIXED = {"events": "events", "pages": "pages", "documents": "documents"}

SOURCES = ", ".join(
    f"({rank}, '{url}', {cap})" for _, url, _, cap, rank in source_rows()
)
WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
NOW = "'2024-01-31T12:00:00'"
CUTOFF = "timestamp '2024-01-17 00:00:00'"
PURGED = "timestamp '2024-01-01 12:00:00'"
SPLIT = "timestamp '2024-01-16 00:00:00'"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def valid(url: str) -> str:
    return (
        f"coalesce(regexp_matches(trim({url}), '^(https?:)?//') "
        f"and not regexp_matches(lower(trim({url})), '[.](pdf|doc|docx|zip|mp4|avi|mp3)$') "
        f"and not regexp_matches(lower(trim({url})), 'localhost|127[.]0[.]0[.]1') "
        f"and length(trim({url})) >= 10, false)"
    )


def normal(url: str) -> str:
    return (
        f"case when starts_with(trim({url}), '//') then 'https:' || trim({url}) "
        f"when starts_with(trim({url}), '/') then '' else trim({url}) end"
    )


def trusted(url: str) -> str:
    return (
        f"(length({url}) <= 200 and regexp_matches({url}, '^https?://') "
        f"and (contains(lower({url}), 'example.net') or contains(lower({url}), 'example.org')))"
    )


def published_ts(text: str) -> str:
    return f"""case
      when regexp_matches({text}, 'Z$') then strptime({text}, '%Y-%m-%dT%H:%M:%SZ')
      when contains({text}, '+05:30')
        then strptime(replace({text}, '+05:30', ''), '%Y-%m-%dT%H:%M:%S') - interval 330 minute
      when regexp_matches({text}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}$')
        then strptime({text}, '%Y-%m-%dT%H:%M:%S')
      when regexp_matches({text}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then strptime({text}, '%Y-%m-%d')
      when regexp_matches({text}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}[+]00:00$')
        then strptime(replace({text}, '+00:00', ''), '%Y-%m-%dT%H:%M:%S')
      end"""


def api_published(text: str) -> str:
    return f"""case when {text} = '' or {text} = 'Tomorrow' then {NOW}
      when contains({text}, 'T') then replace({text}, 'Z', '+00:00') else {text} end"""


VIEWS = {
    "articles": ARTICLES.replace("{array_open}", "[").replace("{array_close}", "]").format(**FIXED),
    "pages_meta": PAGES_META.format(**FIXED),
    "page_images": f"""
        select url, case page_id % 4
            when 0 then 'https://cdn.example.com/og/' || page_id || '.jpg'
            when 1 then 'https://cdn.example.com/tw/' || page_id || '.jpg'
            when 2 then 'https://cdn.example.com/ft/' || page_id || '.jpg' end as page_image
        from pages where {trusted('url')} and page_id % 4 <> 3""",
    "enriched": """
        select a.*, trim(a.image) <> '' as had_image,
               case when trim(a.image) <> '' then a.image else coalesce(i.page_image, '') end as final_image
        from articles a left join page_images i on a.url = i.url""",
    "prepared": f"""
        select *, substr(md5(url), 1, 16) || '_' || strftime(scraped_at, '%Y%m%d') as article_id
        from articles where url <> ''""",
    "stored": f"""
        select * from prepared where scraped_at < {SPLIT}
        qualify row_number() over (partition by url order by scraped_at desc, ord desc) = 1""",
    "merged": f"""
        select p.url, p.ord, p.title, p.source, p.scraped_at, coalesce(s.article_id, p.article_id) as article_id
        from (select * from prepared
              qualify row_number() over (partition by url order by scraped_at desc, ord desc) = 1) p
        left join stored s using (url)""",
    # Feed items as ingested: defaults, trimmed text, expected image, place in the document.
    "feed_items": f"""
        select *, row_number() over (partition by payload_id order by ord) - 1 as position,
          case when payload_id % 2 = 0 then 3 else 2 end as cap
        from (
          select ord, cast(regexp_extract(source, '^src([0-9]+)', 1) as bigint) as source_rank,
            cast(floor(ord / 100) as bigint) * 1000
              + cast(regexp_extract(source, '^src([0-9]+)', 1) as bigint) as payload_id,
            case when ord % 29 = 0 then 'No Title' else trim(title, {WS}) end as title,
            url, published, source, tags, image as raw_image,
            trim(case ord % 9
              when 3 then summary || '<p><img alt="a>b" src="' || image || '"></p>'
              when 6 then summary || '<p><img alt="a>b" data-src="' || image || '"></p>'
              else summary end, {WS}) as summary,
            case when not {valid('image')} then ''
              when ord % 9 in (0, 1, 2, 4, 5) then image
              when ord % 9 in (3, 6, 7) then {normal('image')}
              else '' end as image
          from articles)""",
    "feed_found": "select * from feed_items where payload_id % 7 <> 3",
    "feed_articles": "select * from feed_found where position < cap",
    "api_items": f"""
        select *, row_number() over (partition by payload_id order by ord) - 1 as position
        from (
          select ord, list_extract({CATEGORIES!r}, cast(ord % 11 as int) + 1) as category,
            cast(floor(ord / 200) as bigint) * 100 + ord % 11 as payload_id,
            case when ord % 19 = 0 then '' else title end as title, url,
            {api_published("case when ord % 13 = 0 then 'Tomorrow' else published end")} as published,
            summary, 'inshorts.com' as source,
            case when ord % 9 = 0 then [] else tags end as own_tags, image,
            'h' || ord as inshorts_id, source as original_source
          from articles)
        where payload_id % 13 <> 5""",
    "category_dim": """
        select * from (values ('top_stories', 15, 1), ('trending', 12, 2), ('business', 8, 3),
          ('technology', 8, 4), ('world', 8, 5), ('sports', 6, 6), ('entertainment', 6, 7),
          ('science', 5, 8), ('automobile', 4, 9), ('politics', 6, 10))
          as t(category, max_limit, priority)""",
    "api_capped": """
        select i.*, array_to_string(list_append(own_tags, category), '|') as tags_text,
               coalesce(priority, 11) as source_rank
        from api_items i left join category_dim c using (category)
        where position < coalesce(max_limit, 5)""",
    "topics": """
        select payload_id, doc_id, topic,
               row_number() over (partition by payload_id order by doc_id) - 1 as position
        from (select cast(floor(doc_id / 10) as bigint) as payload_id, doc_id,
                     case when doc_id % 8 = 0 then '' else lang || '-' || source end as topic
              from documents)
        where payload_id % 7 <> 6""",
    "page_links": """
        select page_id, place, split_part(anchor, '"', 2) as written,
          trim(replace(regexp_extract(anchor, '>([^<]*)</a>', 1), '&amp;', '&')) as title
        from (select page_id, generate_subscripts(anchors, 1) as place, unnest(anchors) as anchor
              from (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as anchors
                    from pages))""",
    "listing_links": """
        select *, row_number() over (partition by page_id order by place) - 1 as position
        from (
          select page_id, place, title,
            'https://medium.com' || case when page_id % 3 = 0 then '/p/' else '/@' end
              || substr(written, 2) as url, '' as image
          from page_links where page_id % 3 <> 2 and starts_with(written, '/') and length(title) > 10
          union all
          select page_id, 100000 + k, replace(title, '{n}', cast(page_id as varchar)),
            'https://medium.com' || replace(path, '{n}', cast(page_id as varchar)),
            replace(image, '{n}', cast(page_id as varchar))
          from pages, (values
            (0, 'Story zero of page {n}', '/p/{n}-0', 'https://cdn.example.com/l/{n}-0.jpg'),
            (1, 'Story one of page {n}', '/@w/{n}-1', 'https://cdn.example.com/l/{n}-1.jpg'),
            (2, 'Story two of page {n}', '/p/{n}-2', 'https://cdn.example.com/l/{n}-2.jpg'),
            (3, 'Story threeof page {n}', '/p/{n}-3', 'https://cdn.example.com/l/{n}-3.jpg'),
            (6, 'Story six of page {n}', '/p/{n}-6', 'https://cdn.example.com/l/{n}-6.jpg')
          ) as g(k, title, path, image))""",
    "collected": f"""
        select source_rank, payload_id, position, title, url, published, summary, source,
               array_to_string(tags, '|') as tags_text, image from feed_articles
        union all
        select 36, page_id, position, title, url, {NOW}, '', 'medium.com', 'trending', image
        from listing_links where position < 5
        union all
        select 37 + source_rank, payload_id, position, title, url, published, summary, source,
               tags_text, image from api_capped where title <> '' and url <> ''""",
    "unique_collected": f"""
        select *, coalesce({published_ts('published')}, timestamp '0001-01-01 00:00:00') as ts
        from collected where url <> ''
        qualify row_number() over (partition by url order by source_rank, payload_id, position) = 1""",
    "collected_images": """
        select c.* exclude (image),
               trim(c.image) <> '' or (c.source_rank < 36 and i.page_image is not null) as had_image,
               case when trim(c.image) <> '' then c.image else coalesce(i.page_image, '') end as image
        from unique_collected c left join page_images i on c.url = i.url""",
    "suppliers": "select 'src' || s_suppkey || '.example.com' as source, s_acctbal, s_nationkey from supplier",
}


def over_views(body: str) -> str:
    """Put the views a query uses before it, in an order that resolves."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        words = set(re.findall(r"\b(?:from|join)\s+(\w+)", sql))
        for name in VIEWS:
            if name in words and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    return "with " + ",\n".join(f"{name} as ({VIEWS[name]})" for name in ordered) + "\n" + body


COVERAGE = (
    "count(*) filter (where trim(image) <> '') as with_image, count(*) as total, "
    "round(100.0 * cast(count(*) filter (where trim(image) <> '') as double) / count(*), 1) as percent"
)

TOP_N = f"""select e.ord, e.title, e.url, e.published, e.final_image as image, e.had_image,
      row_number() over (order by e.had_image desc,
    coalesce({published_ts('e.published')}, timestamp '0001-01-01 00:00:00') desc, e.ord) as place
    from (select * from articles where url <> ''
      qualify row_number() over (partition by url order by ord) = 1
      order by coalesce({published_ts('published')}, timestamp '0001-01-01 00:00:00') desc, ord
      limit 50) top
    join enriched e on e.ord = top.ord"""

BODIES = {
    "dedup_first": """select ord, url, title, source from articles where url <> ''
        qualify row_number() over (partition by url order by ord) = 1""",
    "source_cap": """select ord, source, title, url from articles
        qualify row_number() over (partition by source order by ord) <= 3""",
    "latest_by_published": f"""select ord, published, {stamp(published_ts('published'))} as published_ts,
          row_number() over (order by coalesce({published_ts('published')}, timestamp '0001-01-01 00:00:00') desc, ord)
            as place from articles""",
    "number_articles": f"""select row_number() over (order by {published_ts('published')} desc nulls last, ord) as place,
        ord from articles""",
    "top_n_digest": TOP_N,
    "top_n_by_candidates": TOP_N,
    "image_valid": f"select ord, image, {valid('image')} as valid from articles",
    "image_normalize": f"select ord, {normal('image')} as image from articles",
    "html_first_image": """select doc_id, case doc_id % 7
          when 1 then 'https://cdn.example.com/d/' || doc_id || '.png'
          when 3 then 'https://cdn.example.com/d/' || doc_id || '.jpg?a=1&b=2'
          when 4 then '' when 6 then ''
          else 'https://cdn.example.com/d/' || doc_id || '.jpg' end as image from documents""",
    "page_meta_image": "select url, page_image from page_images",
    "page_image_lookup": f"""select url, page_image, (select count(*) from pages where {trusted('url')}) as parsed_first,
          0 as parsed_again from page_images""",
    "srcset_first": """select ord, split_part(trim(split_part('  ' || image || ' 1x', ',', 1)), ' ', 1)
        as candidate from articles""",
    "enrich_images": """select ord, url, final_image as image, had_image,
          row_number() over (order by had_image desc, ord) as place from enriched""",
    "fallback_image": """select e.ord, case when e.had_image or e.final_image <> '' then e.final_image
          else coalesce('https://cdn.example.com/default/' || lpad(cast(s.s_nationkey as varchar), 3, '0'), '') end as image
        from enriched e left join suppliers s on s.source = e.source""",
    "image_coverage": f"""select source, false as overall, {COVERAGE} from articles group by source
        union all select null, true, {COVERAGE} from articles""",
    "coverage_gain": """select total, before_percent, after_percent,
          round(after_percent - before_percent, 1) as gain_points, after_percent >= 95 as goal_met
        from (select count(*) as total,
                round(100.0 * cast(count(*) filter (where had_image) as double) / count(*), 1) as before_percent,
                round(100.0 * cast(count(*) filter (where trim(final_image) <> '') as double) / count(*), 1)
                  as after_percent from enriched)""",
    "source_host": "select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages",
    "href_absolutize": """select page_id, position, href,
          case when starts_with(href, '/') then 'https://medium.com' || href else href end as url
        from (
          select page_id, place - 1 as position,
            case page_id % 3 when 0 then '/p' || link when 1 then '/@' || substr(link, 2) end as href
          from (select page_id, generate_subscripts(links, 1) as place, unnest(links) as link
                from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as links from pages))
          where page_id % 3 <> 2 and starts_with(link, '/')
          union all
          select page_id, len(regexp_extract_all(html, 'href="[^"]*"')) + k, replace(path, '{n}', cast(page_id as varchar))
          from pages, (values (0, '/p/{n}-0'), (1, '/@w/{n}-1'), (2, 'https://medium.com/p/{n}-2'),
            (3, '/p/{n}-3'), (5, '/p/{n}-5'), (6, '/p/{n}-6')) as g(k, path))""",
    "article_preview": """select row_number() over (order by ord) as number, title, source, url,
          array_to_string(tags, ', ') as tags_text,
          substr(summary, 1, 150) || case when length(summary) > 150 then '...' else '' end as summary_preview
        from articles""",
    "url_list": "select row_number() over (order by ord) as number, url from articles where url <> ''",
    "filter_source": "select ord, title, source from articles where source = 'src3.example.com'",
    "published_normalize": f"select ord, {api_published('published')} as published from articles",
    "feed_ingest_xml": """select source_rank, payload_id, position, title, url, published, summary, source,
          array_to_string(tags, '|') as tags_text, image from feed_articles""",
    "feed_image_cascade": """select payload_id, position, f.url,
          case when image <> '' then image else coalesce(page_image, '') end as image
        from feed_found f left join page_images i on f.url = i.url""",
    "feed_source_config": f"""select rank as source_rank, payload_id, position,
          regexp_extract(feed_url, '//([^/]*)', 1) as source, title, url
        from feed_found join (values {SOURCES}) as s(rank, feed_url, feed_cap)
          on source_rank * 2 % 37 = rank
        where position < feed_cap""",
    "feed_rejects": """select distinct 'https://' || source || '/feed/' || payload_id as feed_url, payload_id,
          'unreadable' as reason from feed_items where payload_id % 7 = 3""",
    "api_parse": """select payload_id, position, title, url, published, summary, source,
          array_to_string(list_append(own_tags, category), '|') as tags_text, image, inshorts_id, original_source
        from api_items where title <> '' and url <> ''""",
    "api_category_cap": """select source_rank, payload_id, position, inshorts_id, url
        from api_capped where title <> '' and url <> ''""",
    "api_rejects": """select category, count(*) as rejected from api_capped
        where title = '' or url = '' group by category""",
    "unreadable_responses": f"""select distinct category, payload_id, 'unreadable' as reason
        from (select list_extract({CATEGORIES!r}, cast(ord % 11 as int) + 1) as category,
                cast(floor(ord / 200) as bigint) * 100 + ord % 11 as payload_id from articles)
        where payload_id % 13 = 5""",
    "unconfigured_feeds": """select distinct 'unknown' || source_rank as name, payload_id, 'unconfigured' as reason
        from feed_items where source_rank % 5 = 0""",
    "category_cap_window": f"""select category, ord, title from (
          select ord, title, list_extract({CATEGORIES!r}, cast(ord % 11 as int) + 1) as category from articles)
        left join category_dim using (category)
        qualify row_number() over (partition by category order by ord) <= coalesce(max_limit, 5)""",
    "trending_topics": "select payload_id, position, topic from topics",
    "topic_counts": "select topic, count(*) as mentions from topics group by topic",
    "link_harvest": "select page_id, position, title, url from listing_links",
    "listing_image": "select page_id, position, image from listing_links",
    "listing_ingest": f"""select 36 as source_rank, page_id as payload_id, position, title, url,
          {NOW} as published, '' as summary, 'medium.com' as source, 'trending' as tags_text, image
        from listing_links where position < 5""",
    "union_sources": """select title, url, source, image from articles
        union all select null, url, 'pages', null from pages""",
    "daily_digest": """select source_rank, payload_id, position, title, url, published, summary, source,
          tags_text, image, had_image,
          row_number() over (order by had_image desc, ts desc, source_rank, payload_id, position) as place
        from (select * from collected_images order by ts desc, source_rank, payload_id, position limit 50)""",
    "full_digest": """select source_rank, payload_id, position, title, url, published, image, had_image
        from collected_images""",
    "article_id": """select ord, substr(md5(url), 1, 16) || '_20240131' as article_id,
          '2024-01-31 12:00:00.000000' as scraped_at from articles where url <> ''""",
    "type_repair": f"""select ord, case when published = '' then {NOW} else published end as published,
          case when ord % 4 = 0 then '' else array_to_string(tags, '|') end as tags_text
        from articles where url <> ''""",
    "upsert_current": f"select url, ord, title, article_id, {stamp('scraped_at')} as scraped_at from merged",
    "upsert_outcome": f"""select count(distinct url) filter (where url <> '' and not known) as inserted,
          count(*) filter (where url <> '')
            - count(distinct url) filter (where url <> '' and not known) as updated,
          count(*) filter (where url = '') as rejected, count(*) filter (where url <> '') > 0 as success
        from (select a.url, s.url is not null as known from articles a left join stored s on a.url = s.url
              where a.scraped_at >= {SPLIT})""",
    "store_round_trip": f"select url, title, article_id, {stamp('scraped_at')} as scraped_at from merged",
    "store_last_wins": f"""select url, title, {stamp('scraped_at')} as scraped_at from (
          select url, ord, title, scraped_at, 1 as saved from articles
          union all select url, ord, 'again ' || title, scraped_at, 2 from articles where ord % 2 = 0
          union all select url, ord, 'older ' || title, scraped_at - interval 90 day, 3 from articles where ord % 3 = 0) l
        where url <> '' qualify row_number() over (partition by url order by saved desc, l.scraped_at desc, ord desc) = 1""",
    "store_purge": f"""select url, article_id, {stamp('scraped_at')} as scraped_at from merged
        where scraped_at >= {CUTOFF}""",
    "store_known_addresses": f"""select url, article_id, source, {stamp('scraped_at')} as scraped_at, 1 as saved from stored
        where url in (select url from articles where scraped_at >= {SPLIT})""",
    "store_changes": f"""select {stamp('scraped_at')} as scraped_at, source, count(*) as articles from merged
        where scraped_at >= {CUTOFF} group by all""",
    "purge_keep": f"select ord, url, {stamp('scraped_at')} as scraped_at from articles where scraped_at >= {CUTOFF}",
    "purge_report": f"""select true as success, false as dry_run,
          count(*) filter (where scraped_at < {CUTOFF}) as deleted_count,
          cast(null as bigint) as would_delete_count,
          count(*) filter (where scraped_at >= {CUTOFF}) as total_remaining,
          '2024-01-17T00:00:00' as cutoff_date from articles""",
    "purge_dry_run": f"""select true as success, true as dry_run, cast(null as bigint) as deleted_count,
          count(*) filter (where scraped_at < {CUTOFF}) as would_delete_count,
          count(*) as total_remaining, '2024-01-17T00:00:00' as cutoff_date from articles""",
    "purge_sample": f"""select title, source, {stamp('scraped_at')} as scraped_at from articles
        where scraped_at < {CUTOFF} order by articles.scraped_at, ord limit 5""",
    "recent_articles": f"""select url, title, {stamp('scraped_at')} as scraped_at,
          row_number() over (order by u.scraped_at desc, url) as place from (
          select * from prepared where url <> ''
          qualify row_number() over (partition by url order by scraped_at desc, ord desc) = 1) u
        where scraped_at >= timestamp '2024-01-24 00:00:00' order by u.scraped_at desc, url limit 100""",
    "json_snapshot": """select title, url, summary, array_to_string(tags, '|') as tags_text,
          strftime(scraped_at, '%Y-%m-%dT%H:%M:%S')
            || case when microsecond(scraped_at) % 1000000 = 0 then ''
               else strftime(scraped_at, '.%f') end as scraped_at from articles""",
    "snapshot_backup": f"""select n as source_rows, n as copied_rows, true as identical
        from (select count(*) + count(*) filter (where scraped_at < {CUTOFF}) as n from articles)""",
    "backup_incremental": f"""select backup, 2 as snapshots, source_rows, copied_snapshots, copied_rows, true as identical, source_rows as restored_rows
        from (select unnest([0, 1, 2]) as backup, unnest([whole + old, whole + old, whole + whole - old]) as source_rows,
                unnest([2, 0, 1]) as copied_snapshots, unnest([whole + old, 0, whole - old]) as copied_rows
              from (select count(*) as whole, count(*) filter (where scraped_at < {CUTOFF}) as old from articles))""",
    "daily_job": f"""select count(*) filter (where not known) as inserted,
          count(*) filter (where known) as updated, 0 as rejected,
          (select count(*) from stored where scraped_at < {PURGED}) as deleted_count,
          (select count(*) from stored where scraped_at >= {PURGED}) + count(*) filter (where not known)
            as total_articles,
          count(*) as listed, true as purged,
          (select count(*) - count(distinct url) filter (where url <> '') from articles
            where scraped_at >= {SPLIT}) as removed,
          count(*) filter (where final_image <> '') as with_image
        from (select i.url, s.url is not null as known, e.final_image from (
                select * from (select * from articles where url <> '' and scraped_at >= {SPLIT}
                  qualify row_number() over (partition by url order by ord) = 1)
                order by coalesce({published_ts('published')}, timestamp '0001-01-01 00:00:00') desc, ord
                limit 50) i
              join enriched e on e.ord = i.ord
              left join stored s on s.url = i.url and s.scraped_at >= {PURGED})""",
    "article_count": "select count(*) as total_articles from articles",
    "store_statistics": """select source, count(*) as count, (select count(*) from merged) as total_articles,
          (select count(*) from merged where scraped_at >= timestamp '2024-01-24 00:00:00') as last_week,
          (select count(*) from merged where scraped_at >= timestamp '2024-01-01 00:00:00') as last_month,
          (select count(*) from merged where scraped_at < timestamp '2023-12-02 00:00:00') as older
        from merged group by source order by count(*) desc, source limit 10""",
    "age_buckets": """select count(*) as total_articles,
          count(*) filter (where scraped_at >= timestamp '2024-01-24 00:00:00') as last_week,
          count(*) filter (where scraped_at >= timestamp '2024-01-01 00:00:00') as last_month,
          count(*) filter (where scraped_at < timestamp '2024-01-11 00:00:00') as older from articles""",
    "top_sources": """select source, count(*) as count from articles group by source
        order by count(*) desc, source limit 10""",
    "dedup_metrics": """select count(*) as rows_in, count(*) filter (where url = '') as blank_urls,
          count(distinct url) filter (where url <> '') as rows_out,
          count(*) - count(distinct url) filter (where url <> '') as removed from articles""",
    "empty_sources": """select 'src' || p_partkey || '.example.com' as source from part
        where 'src' || p_partkey || '.example.com' not in (select source from articles where url <> '')""",
    "category_capacity": """select count(*) as categories, sum(max_limit) as max_articles
        from category_dim where category in (select category from api_items)""",
    "category_priority": """select category, delivered, max_limit, priority
        from (select category, count(*) as delivered from api_items group by category)
        join category_dim using (category) order by priority limit 5""",
    "daily_arrivals": """select cast(cast(scraped_at as date) as varchar) as day, source, count(*) as articles
        from articles group by 1, 2""",
    "stream_ingest": "select source_rank, payload_id, position, title, url, image from feed_articles",
    "stream_dedup": "select distinct url, true as whole from articles where url <> ''",
    "stream_upsert": f"select url, title, {stamp('scraped_at')} as scraped_at from merged",
    "stream_late_rows": f"""select cast(cast(scraped_at as date) as varchar) as day, source,
          count(*) filter (where not late) as articles, count(*) filter (where late) as late
        from (select *, scraped_at < {SPLIT} and scraped_at < (select max(scraped_at) from articles) - interval 20 day as late
              from articles) group by 1, 2""",
    "stream_daily_arrivals": """select cast(cast(scraped_at as date) as varchar) as day, source,
          count(*) as articles from articles group by 1, 2""",
}
BODIES["stream_first_arrivals"] = BODIES["dedup_first"]
BODIES["store_recent"] = BODIES["recent_articles"]

ORACLE = {name: over_views(body) for name, body in BODIES.items()}
