from tessera.operators.aggregates import (audit_files, catalog_document, class_totals, daily_average, group_ids,
                                          pivot_classes, row_count, row_total, status_counts)
from tessera.operators.filters import day_bounds, in_scope, matching, not_in, null_key_rows, older_than, time_range
from tessera.operators.inspect import profile
from tessera.operators.joins import (add_row_index, attach_metadata, positional_join, referencing_groups,
                                     restrict_to, rules_from_nested, unreferenced)
from tessera.operators.projection import (add_constant, apply_mapping, drop_columns, drop_null_fields,
                                          fill_defaults, make_struct, rename_all)
from tessera.operators.ranking import ranked
from tessera.operators.sets import align_union, distinct_edges, edges_at, edges_from, ids_at, ids_of, nested_ids, union_edges
from tessera.operators.upsert import latest_per_key, upsert
