"""Logs, status rows, settings and catalogs derived from the driver tables.

The tables hold none of these, so they are computed from ``events`` and ``customer``, over all rows.
Each text is valid in Spark and in DuckDB; the source table stands in braces.
"""

VIEWS: dict[str, tuple[str, str]] = {
    "v_log": (
        """
        select event_id, ts,
          case event_type
            when 'error' then concat('urllib3 NotOpenSSLWarning', chr(10),
              '  Error: permission denied for user ', cast(user_id as string), '  ', chr(10), 'done')
            when 'purchase' then concat('CLI v0.254.0 found at /bin', chr(10),
              'max limit of scopes reached', chr(10), 'request INVALID')
            when 'view' then concat('ok', chr(10), 'app ', cast(user_id as string), ' not found')
            when 'click' then concat('step one', chr(10), 'step two ')
            else '' end as raw
        from {events}""",
        "events",
    ),
    "v_status": (
        """
        select user_id as app_id, event_id, ts,
          case event_type when 'signup' then 'STARTING' when 'view' then 'PENDING'
            when 'error' then 'CRASHED' else 'RUNNING' end as app_state,
          case when value < 10 then 'ACTIVE' when value < 20 then 'STARTING' else 'STOPPED' end
            as compute_state
        from {events}""",
        "events",
    ),
    "v_settings": (
        """
        select user_id as session_id, event_id, ts,
          case when event_type = 'signup' then 'gpt-4'
            when event_type = 'purchase' then 'gpt-3.5-turbo' end as model,
          case when event_type in ('view', 'purchase') then round(value / 20, 1) end as temperature,
          case when event_type = 'click' then concat('prompt ', cast(event_id as string)) end
            as system_prompt,
          case when event_type = 'error' then value > 10 end as dark_mode
        from {events}""",
        "events",
    ),
    "v_deployments": (
        """
        select user_id as app_id, concat('dep', cast(event_id as string), 'abcdef') as deployment_id,
          ts as create_time,
          case when event_type = 'error' then 'FAILED' else 'SUCCEEDED' end as state
        from {events}""",
        "events",
    ),
    "v_json": (
        """
        select event_id, props,
          case event_type when 'view' then props
            when 'click' then concat('WARN cli ', props, ' tail')
            when 'error' then concat('out: [', props, ', {{"k": "a}}"}}]')
            when 'purchase' then concat('cut off ', replace(props, '}}', ''))
            else 'no json here' end as raw,
          event_type
        from {events}""",
        "events",
    ),
    "v_config": (
        """
        select event_id,
          case when event_type = 'view'
            then concat('value: {{{{secrets/scope', cast(user_id as string), '/key_a}}}}', chr(10),
              'other: {{{{secrets/shared/key_', cast(event_id as string), '}}}}')
            else 'value: none' end as raw
        from {events}""",
        "events",
    ),
    "v_items": (
        """
        select concat(case when c_mktsegment = 'BUILDING' then 'Shared-' else 'team-' end, c_name)
            as name,
          concat('owner', cast(c_nationkey as string)) as owner
        from {customer}""",
        "customer",
    ),
    "v_grants": (
        """
        select concat(case when c_mktsegment = 'BUILDING' then 'Shared-' else 'team-' end, c_name)
            as name,
          concat('owner', cast(case when c_mktsegment = 'MACHINERY' then 0 else c_nationkey end
            as string)) as principal,
          case when c_acctbal > 3000 then 'MANAGE' when c_acctbal > 0 then 'READ' else 'WRITE' end
            as permission
        from {customer}""",
        "customer",
    ),
    "v_listing": (
        """
        select c_custkey as source,
          concat(chr(10), 'Name   Backend', chr(10), c_name, '  ', c_mktsegment, chr(10), chr(10),
            '  segment-', c_mktsegment, '   B ', chr(10)) as raw
        from {customer}""",
        "customer",
    ),
    "v_users": (
        """
        select c_custkey as user_id, lower(replace(c_name, '#', '.')) as user_name,
          case when c_mktsegment = 'BUILDING' then null
            else concat('user.', cast(c_custkey as string), '@', lower(c_mktsegment), '.example.com')
          end as email
        from {customer}""",
        "customer",
    ),
}


def sql_text(name: str) -> str:
    text, source = VIEWS[name]
    return text.format(**{source: source})
