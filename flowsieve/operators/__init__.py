"""DataFrame operators and estimators' drivers."""
