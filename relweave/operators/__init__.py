"""The fluent API: queries, preloads, pages, options, extensions."""
