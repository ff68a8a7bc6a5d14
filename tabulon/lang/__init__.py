"""Query language: lexer, clauses, names and expression compilers."""
