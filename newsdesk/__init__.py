"""newsdesk: a PySpark-native analytics engine for content feeds."""
