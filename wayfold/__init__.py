"""wayfold"""
