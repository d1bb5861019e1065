"""Operators for preparing language-model training data at corpus scale.

Nothing outside this folder imports it; it can be removed as a whole.
"""
