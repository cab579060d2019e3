"""Plan building blocks shared by the operators: size checks, ordered groups, as-of and interval joins."""
