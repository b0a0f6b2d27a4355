"""DataFrame operators.  Every operator is ``f(df, ..., **params) ->
DataFrame`` and only adds or filters columns/rows lazily."""
