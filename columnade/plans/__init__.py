"""From text to a typed plan: lexer, parser, binder, folding, and emission of Spark columns."""
